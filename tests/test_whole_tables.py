"""Queries over all rows: paths for large tables against those for small ones, and rows that SQL leaves out."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.sources.echoes import letters, words
from tracewell.functions import sentences
from tracewell.functions.textview import normal
from tracewell.functions.udfs import _gate, is_ascii, normal_form
from tracewell.operators import auditability
from tracewell.plans import views
from tracewell.plans.model import Runs


def test_quotes_in_any_number_of_passes(spark, tmp_path):
    long = "A sentence of the benchmark that is longer than its key."
    docs = [(1, f"Before. {long} After."), (None, f"{long} cat"), (2, "cat"), (3, None), (4, ""), (5, "a cat, a cat é日本"), (5, "another cat"), (6, "cat"), (6, "cat"), (7, long[:24] + "!")]
    items = [(1, long), (2, "cat"), (3, "c"), (4, "é日本"), (5, "cat"), (5, "cat"), (6, ""), (7, None), (8, long[:24]), (9, long[:23]), (None, "another"), (10, "nowhere")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(((i, d, t.index(q)) for i, q in items if q for d, t in docs if t and q in t), key=repr)
    assert sorted(map(tuple, catalog.benchmark_in_documents(spark, str(tmp_path)).collect()), key=repr) == want
    read = [spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("benchmark", "documents")]
    for most in (250, 10**6):
        got = catalog.found_quotes(read[0].where("text <> ''").selectExpr("item_id", "text AS quote"), read[1], most)
        assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("width", [1, 5, 23, 24, 40])
def test_items_of_every_length_are_found(spark, width):
    text = "The quick brown fox jumps over the lazy dog and runs away from it."
    items = spark.createDataFrame([(k, text[k : k + width]) for k in range(len(text) - width + 1)], "item_id long, quote string")
    docs = spark.createDataFrame([(7, text), (8, "nothing")], "doc_id long, text string")
    want = sorted((k, 7, text.index(text[k : k + width])) for k in range(len(text) - width + 1))
    for most in (2500, 10**6):
        assert sorted(map(tuple, catalog.found_quotes(items, docs, most).where("doc_id = 7").collect())) == want


def test_gates_answer_for_runs_with_numbers(spark, tmp_path):
    """Brute force: the gate on the one span that each run cites, and the mutations that the text doesn't matter for."""
    first = [f"{w} report of the year counted{' 66' if k % 2 else ' all'}" for k, w in enumerate("One Two Three Four Five Six Seven Eight Nine Ten".split())]
    seconds = ["300 people of the town were there", "Many people of the town were there"]
    docs = [(i, first[i % 10] + f" of {'abcdefghijk'[i // 10]} 66" * (i % 3 == 0), seconds[i % 4 // 2]) for i in range(1, 101)]
    rows = [(i, ". ".join([p0, p1, "A third sentence of the text", "A fourth sentence of the text"])) for i, p0, p1 in docs]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fixed = {1: "not_reachable_from_step", 2: "artifact_unknown", 3: "self_citation", 4: "span_out_of_range", 5: "no_quoted_span", 8: "assumption_undeclared"}
    want = {}
    for (i, p0, p1), (_, inv, _) in zip(docs, docs[1:], strict=False):
        if inv not in rows[i - 1][1]:
            start = 1 if i % 9 == 6 else 0
            want[str(i)] = fixed.get(i % 9) or _gate(f"{p0} {p1} {inv}", start, len(p0), p0[start:] + "x" * (i % 9 == 7))
    assert len(want) > 90 and {"ok", "span_cuts_a_number", "span_cuts_a_word", "span_mismatch"} <= set(want.values())
    got = catalog.queries()["hop_gate_reasons_all"](spark, str(tmp_path)).collect()
    assert {r.run_id: r.reason for r in got} == want and len(got) == len(want)
    shown = {r.run_id: r.reason for r in catalog.hop_gate_reasons(spark, str(tmp_path)).collect()}
    assert shown.items() < want.items() and "span_cuts_a_number" not in shown.values()


def test_normal_form_of_all_documents(spark, tmp_path):
    docs = [(1, "  The \u201cQuick\u201d \n fox\u2014jumps\u00ad "), (2, "Plain  TEXT"), (3, None), (4, ""), (5, "cafe\u0301 \u65e5\u672c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.normal for r in catalog.queries()["doc_normalized"](spark, str(tmp_path)).collect()}
    assert got == {1: 'the "quick" fox-jumps', 2: "plain text", 3: None, 4: "", 5: "caf\u00e9 \u65e5\u672c"}


def test_replies_of_tools_by_a_plain_search(spark):
    """Every reply of the conversations' tools: model text if it is, or has as a line, what the call was given; else noted
    by the share of its letters in runs of words that stand in the call that it answers, in earlier ones, or in a message."""
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect()
    by, want = {}, {}
    for r in rows:
        by.setdefault(str(r.conv_id), []).append(r)

    def share(reply, texts):
        said, k, covered = words(reply), 0, 0
        inside = lambda a, b: any(t[i : i + b - a] == said[a:b] for t in texts for i in range(len(t) - (b - a) + 1))
        while k < len(said):
            end = k
            while end < len(said) and inside(k, end + 1):
                end += 1
            n = sum(map(letters, said[k:end]))
            covered += n if n >= 8 else 0
            k = max(end, k + 1)
        return covered / max(1, sum(map(letters, said)))

    for run, turns in by.items():
        at = nth = 0
        given = []
        for r in turns:
            text = r.text or ""
            if r.role != "assistant":
                at += 1
                continue
            before = given[-1] if given else ""
            reply = [text, f"Stored today {text} it says\nfine", f"Record number {r.turn} holds nothing of that kind", f"Entry: {before}"][nth % 4]
            spelt = lambda t: [words(json.dumps({"note": t}, separators=(",", ":"), ensure_ascii=False)), words(t)]
            if reply.strip():
                name = f"t{at + 1}"
                lines = lambda t: {" ".join(x.split()) for x in t.splitlines() if x.strip()}
                if nth % 4 == 0 or lines(reply) & lines(text):
                    want[run, name] = ("intermediate", None)
                else:
                    own, earlier = share(reply, spelt(text)), share(reply, [w for g in given for w in spelt(g)])
                    same = any(" ".join(reply.split()) == " ".join(g.split()) for g in given)
                    want[run, name] = ("tool_result", "answering_call" if own >= 0.5 else "earlier_turn" if earlier >= 0.5 or same else None)
            given.append(text)
            nth, at = nth + 1, at + 2
    got = {(r.run_id, r.artifact_id): (r.kind, r.note) for r in catalog.conv_tool_replies(spark, "/root/testdata/sf0.01").collect()}
    wrong = {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k) and (got.get(k) or ("",))[0] != "final_answer"}
    assert len(got) > 100 and {"answering_call", "earlier_turn", None} == {n for _, n in got.values()}
    assert not wrong, list(wrong.items())[:5]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_threads_are_read_without_lists_of_inputs(spark, tmp_path):
    """Findings and counters of chats equal those by their steps' lists, and plans hold no list and one join at most."""
    long = "A text that is long enough to be missed."
    turns = [(1, "user", long), (1, "assistant", "yes"), (1, "user", long), (2, "user", "\u4e00" * 25), (2, "user", "\u4e00 " * 9), (3, "assistant", " "), (3, "system", "\u00a0" * 30 + "abc"), (3, "assistant", None), (4, "assistant", "one"), (4, "user", "\u4e00" * 25), (4, None, "\u4e00\u200b" * 15)]
    rows = [(c, k, role, text) for k, (c, role, text) in enumerate(turns)] + [(9, k, "assistant" if k % 2 else "user", f"{k % 50} {long}") for k in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        t = views.chats(views.read(spark, sf, "conversations"))
        listed = Runs(t.artifacts, t.steps, t.claims, t.entries, t.assumptions)
        for f in (auditability.findings, auditability.check, auditability.step_classes):
            assert sorted(map(str, f(t).collect())) == sorted(map(str, f(listed).collect()))
    got = {(r.run_id, r.code, r.subject) for r in auditability.findings(views.chats(views.read(spark, str(tmp_path), "conversations"))).collect() if r.run_id != "9"}
    assert got == {
        ("1", "orphan_root", "m2"), ("1", "duplicate_content", "m0, m2"), ("2", "no_final_answer", "-"), ("2", "no_steps", "-"), ("3", "empty_artifact", "a5"), ("3", "empty_artifact", "a7"), ("3", "undeclared_inputs", "s5"),
        ("4", "undeclared_inputs", "s8"), ("4", "orphan_root", "m9"),
    }
    for name in ("conv_reachable_share", "conv_findings", "conv_step_classes", "conv_steps_input_counts"):
        plan = _plan(catalog.queries()[name](spark, str(tmp_path)))
        assert "collect_list(artifact_id" not in plan.split("sort_array")[0] and plan.count("Join") <= 1


def test_sentences_are_given_out_as_they_are_found(spark, tmp_path):
    """All sentences of all documents whatever a batch holds, and no more than it may; no column of lists is made."""
    line = "A sentence of several words, e.g. this one. \u4e00 second one stands here! "
    docs = [(1, line * 300), (2, None), (3, ""), (None, "Null ids have sentences too.\n# no heading is one of them"), (4, "x" * 400), (5, line)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, k, a, b, t[a:b]) for d, t in docs for k, (a, b) in enumerate(sentences.sentences(t or ""))]
    got = catalog.doc_sentences(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 600
    assert got.dtypes == [("doc_id", "bigint"), ("nth", "int"), ("start", "int"), ("end", "int"), ("sentence", "string")]
    assert "ArrowEvalPython" not in _plan(got) and "Generate" not in _plan(got)
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in docs], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    for rows, chars in ((7, 10**9), (10**9, 500), (10**9, 10**9)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sentences, "OUT_ROWS", rows)
            patch.setattr(sentences, "OUT_CHARS", chars)
            out = list(sentences._split(iter([batch])))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
        assert all(b.num_rows <= rows and sum(map(len, b.column(4).to_pylist())) < chars + 500 for b in out)


def test_normal_forms_of_ascii_without_python(spark):
    """The same as textview.normal(); only texts with other characters go to Python, in bounded batches."""
    draw = random.Random(3)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = [None, "", " ", "abc\u2028", "\u2028", "\u00df", "\x1cA\x1d\x1eB\x1f\x0b\x0cC\x00 \x7f"] + ["".join(draw.choice("aB1 \t\n\r\x0b\x0c\x1c\x1f\x00\x7f-'\u00e9\u2014"[: draw.choice((16, 18))]) for _ in range(draw.randrange(12))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", "text", normal_form("text").alias("normal"))
    assert all(r.normal == (None if r.text is None else normal(r.text)) for r in got.collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
    assert "CASE WHEN NOT (octet_length(text" in next(x for x in _plan(got).splitlines() if "ArrowEvalPython" in x)
    rows = spark.createDataFrame([(1, "abc\u2028"), (2, "Abc\n"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in rows.where(is_ascii(F.col("text"))).collect()] == [2]


def test_chats_are_sorted_once(spark, tmp_path):
    """Windows over a conversation find it in order, whatever order its rows came in."""
    rows = [(k % 40, (k * 7) % 50, "assistant" if k % 3 else "user", f"text {k}") for k in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    chats = views.chats(views.read(spark, str(tmp_path), "conversations"))
    for df in (chats.artifacts, chats.steps, chats.turns):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Sort" not in plan and "Exchange" not in plan
    last = {}
    for c, turn, role, _ in rows:
        if role == "assistant":
            last[str(c)] = max(turn, last.get(str(c), 0))
    assert {(r.run_id, r.ord) for r in chats.artifacts.where("kind = 'final_answer'").collect()} == set(last.items())
    earlier = {(str(c), turn): sum(x[0] == c and x[1] < turn for x in rows) for c, turn, role, _ in rows if role == "assistant"}
    assert {(r.run_id, r.ord): len(r.inputs) for r in chats.steps.collect()} == earlier
