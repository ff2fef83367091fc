import json
import random

import pytest

from tracewell.audit import audit, check_trace
from tracewell.operators import auditability, propose
from tracewell.plans import fixtures
from tracewell.sources import chat, echoes, files, native, spans, trajectory
from tracewell.streaming import recorder

CALL = {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "search", "arguments": '{"q": "bridge height"}'}}]}


def log(*more):
    return [{"role": "user", "content": "How tall is it?"}, CALL, *more, {"role": "assistant", "content": "It is 134 metres tall."}]


def kinds(run):
    return {a["artifact_id"]: a["kind"] for a in run["artifacts"]}


def test_a_reply_is_evidence_unless_it_is_handed_back():
    assert kinds(chat.to_run(log({"role": "tool", "tool_call_id": "c1", "content": "Height: 134 m"}))) == {"m0": "document", "t2": "tool_result", "a3": "final_answer"}
    echo = chat.to_run(log({"role": "tool", "tool_call_id": "c1", "content": "bridge  height."}))
    assert kinds(echo)["t2"] == "intermediate" and echo["_meta"]["handed_back"] == ["t2"]
    other = {"role": "tool", "tool_call_id": "c1", "content": "Bridge  height"}
    assert kinds(chat.to_run(log(other)))["t2"] == "tool_result"
    assert kinds(chat.to_run(log(other | {"content": "bridge height"}), external_tools=frozenset({"Search"})))["t2"] == "intermediate"
    assert kinds(chat.to_run(log({"role": "tool", "tool_call_id": "c1", "content": "Height"}), model_text_tools=frozenset({"search"})))["t2"] == "intermediate"


def test_replies_match_by_id_name_and_place():
    calls = [{"id": "x", "function": {"name": "f", "arguments": "{}"}}, {"id": "y", "function": {"name": "g", "arguments": "{}"}}]
    t = chat.Turn([chat.Call(c["id"], c["function"]["name"], "") for c in calls])
    assert t.match("y", "")[0].name == "g" and t.match("", "f")[2] and t.match("", "")[0] is None
    t = chat.Turn([chat.Call("", "f", ""), chat.Call("", "g", "")])
    assert not t.match("", "")[2] and not t.match("", "")[2]


def test_dialects_and_truncation():
    data = {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "content": [{"type": "tool_use", "id": "u", "name": "t", "input": {"a": 1}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": "z" * 50}]}]}, {"role": "assistant", "content": "done with it"}]}
    run = chat.to_run(data, tool_chars=10)
    assert [a["kind"] for a in run["artifacts"]] == ["document", "tool_result", "final_answer"] and run["_meta"]["truncated"] == ["t2"]
    deep = []
    for _ in range(300):
        deep = [deep]
    with pytest.raises(native.Malformed):
        chat.arguments_text(deep)


def test_spans_sort_and_merge():
    said = [{"role": "user", "parts": [{"type": "text", "content": "Hello"}]}]
    out = [{"role": "assistant", "parts": [{"type": "text", "content": "Hi there"}]}]
    attr = lambda i, o: [{"key": "gen_ai.input.messages", "value": {"stringValue": json.dumps(i)}}, {"key": "gen_ai.output.messages", "value": {"stringValue": json.dumps(o)}}]
    export = {"resourceSpans": [{"scopeSpans": [{"spans": [{"startTimeUnixNano": "9", "attributes": attr(said + out, [{"role": "assistant", "parts": [{"type": "text", "content": "More"}]}])}, {"startTimeUnixNano": "1", "attributes": attr(said, out)}]}]}]}
    assert files.detect(export) == "otel"
    assert [a["content"] for a in spans.to_run(export)["artifacts"]] == ["Hello", "Hi there", "More"]


def test_trajectory():
    data = {"question": "Q?", "agent_answer": "42", "hallucination_step": 1, "history": [{"step": 1, "role": "a", "content": "think", "tool_calls": [{"name": "calc"}], "tool_responses": ["6*7=42"]}, {"step": 1, "content": "again", "tool_responses": ["42"]}]}
    run = trajectory.to_run(data)
    assert kinds(run) == {"question": "document", "s1": "intermediate", "s1.t0": "tool_result", "s1_2": "intermediate", "s1_2.t0": "tool_result", "answer": "final_answer"}
    assert native.rows(run)["steps"][-1]["inputs"] == ["question", "s1", "s1.t0", "s1_2", "s1_2.t0"]


@pytest.mark.parametrize("raw", [b"\xff\xfe", b"{", b"[1]", b'{"x": 1}', b'{"artifacts": 3}', b'{"artifacts": [{"artifact_id": "a", "kind": "odd", "content": ""}]}', b'{"steps": [], "claims": [{"claim_id": "c", "artifact_id": "a", "start": true, "end": 1}]}', b'{"artifacts": [{"artifact_id": "a", "kind": "document", "content": "\\ud83d"}]}', b"[" * 100_000, b'{"steps": [], "entries": [{"entry_id": "e", "claim_id": "c", "account": "EVIDENCE:a"}]}'])
def test_malformed(raw):
    with pytest.raises(native.Malformed):
        files.read_document(raw)


def test_files(spark, tmp_path):
    run = {"artifacts": [{"artifact_id": "d", "kind": "document", "content": "alpha beta gamma delta"}, {"artifact_id": "a", "kind": "final_answer", "content": "alpha beta"}], "steps": [{"step_id": "s0", "outputs": ["d"]}, {"step_id": "s1", "inputs": ["d"], "outputs": ["a"]}], "claims": [{"claim_id": "c", "artifact_id": "a", "start": 0, "end": 10}], "entries": [{"entry_id": "e", "claim_id": "c", "account": "EVIDENCE:d#0-10", "quoted_span": "alpha beta"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(run).encode())
    (tmp_path / "in/chat.json").write_text(json.dumps(log({"role": "tool", "tool_call_id": "c1", "content": "Height: 134 m, measured in 1990"})))
    (tmp_path / "in/bad.json").write_text("{")
    done = audit(spark, str(tmp_path / "in"))
    assert [r.exit_code for r in done.balance.where("run_id LIKE '%good%'").collect()] == [0]
    assert [r.exit_code for r in done.balance.where("run_id LIKE '%chat%'").collect()] == [2]
    assert "not JSON" in done.bad_runs.first().error
    verdicts, bad = check_trace(spark, str(tmp_path / "in"))
    assert {r.run_id[-9:]: r.verdict for r in verdicts.collect()} == {"good.json": "auditable", "chat.json": "auditable"} and bad.count() == 1
    files.write_runs(done.runs, str(tmp_path / "out"))
    again = files.load_runs(spark, str(tmp_path / "out"))
    document = json.loads(files.to_documents(again).where("run_id LIKE '%good%'").first().json)
    assert native.rows(document)["entries"][0]["quoted_span"] == "alpha beta"


def test_posting(spark):
    runs = fixtures.laundered(spark)
    posted = propose.post(runs)
    entries = {r.claim_id: r for r in posted.entries.orderBy("entry_id").collect()}
    assert posted.claims.count() == 5 and entries["summary.c1"].account.startswith("EVIDENCE:page#") and entries["summary.c2"].account == "PRIOR:model"
    done = audit(spark, posted)
    assert {r.claim_id: r.status for r in done.claims.collect()}["answer.c2"] == "laundered"
    assert propose.post(runs, on_demand=True).entries.count() <= posted.entries.count()
    assert {(r.claim_id, r.artifact_id) for r in propose.self_evident(runs).collect()} == {("summary.c1", "page"), ("answer.c1", "summary"), ("answer.c2", "summary")}


def test_bare_answer():
    assert [c["proposed_by"] for c in propose.segment({"artifact_id": "a", "kind": "final_answer", "content": " 1898 "}, lambda *_: [])] == ["whole-answer"]


def test_findings(spark):
    runs = fixtures.build(spark, [
        {"run_id": "thin", "artifacts": [("d", "document", "x" * 30), ("e", "document", "x" * 30), ("t", "tool_result", " "), ("a", "final_answer", "yes"), ("b", "final_answer", "no")], "steps": [("s1", "generate", [], ["a", "t"]), ("s2", "none", ["d"], [])], "claims": [], "entries": []},
        {"run_id": "empty", "artifacts": [("d", "document", "short")], "steps": [], "claims": [], "entries": []},
    ])
    got = {(r.run_id, r.code, r.subject) for r in auditability.findings(runs).collect()}
    assert got == {
        ("thin", "undeclared_inputs", "s1"), ("thin", "mixed_outputs", "s1"), ("thin", "no_outputs", "s2"), ("thin", "orphan_root", "e"), ("thin", "empty_artifact", "t"), ("thin", "orphan_derived", "b"),
        ("thin", "multiple_final_answers", "a, b"), ("thin", "duplicate_content", "d, e"), ("empty", "no_final_answer", "-"), ("empty", "no_steps", "-"),
    }
    assert {r.run_id: (r.verdict, r.reachable_share) for r in auditability.check(runs).collect()} == {"thin": ("partial", 1.0), "empty": ("unauditable", None)}


def test_recorder(spark, tmp_path):
    page = "The bridge was opened in the year 1932."
    rows = [("t", 1, "retriever_end", "r", "web", None, [page]), ("t", 2, "model_start", "m", None, f"Context: {page} Answer!", None), ("t", 4, "model_end", "m", None, "It opened in 1932.", None), ("t", 3, "error", "gone", None, None, None)]
    runs = recorder.to_runs(spark.createDataFrame(rows, recorder.EVENTS))
    assert {r.kind: r.inputs for r in runs.steps.collect()} == {"retrieve": [], "generate": ["d0"]}
    assert {r.kind for r in runs.artifacts.collect()} == {"document", "final_answer"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.json").write_text("\n".join(json.dumps(dict(zip("trace_id seq event call_id name text documents".split(), r, strict=True))) for r in rows))
    recorder.record(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


NOTE = "The treaty was signed in Vienna by nine states"


def asks(*calls, said=None):
    return {"role": "assistant", "content": said, "tool_calls": [{"id": i, "function": {"name": n, "arguments": a if isinstance(a, str) else json.dumps(a)}} for i, n, a in calls]}


def answers(i, content):
    return {"role": "tool", "tool_call_id": i, "content": content}


def noted(*messages, **options):
    run = chat.to_run([{"role": "user", "content": "When was it signed?"}, *messages, {"role": "assistant", "content": "It was signed in 1815."}], **options)
    return [(n["artifact_id"], n["kind"]) for n in run["_meta"]["echo_notes"]], run


@pytest.mark.parametrize("messages, want", [
    ([asks(("c", "save", {"note": NOTE})), answers("c", f"Stored today {NOTE} it says\nfine")], [("t2", "answering_call")]),
    ([asks(("c", "save", {"note": NOTE})), answers("c", "ok"), asks(("d", "load", {"n": 1})), answers("d", f"Entry one: {NOTE}")], [("t4", "earlier_turn")]),
    ([asks(("c", "save", {"note": NOTE}), ("d", "load", {"n": 1})), answers("c", "ok"), answers("d", f"{NOTE} indeed")], [("t3", "same_turn")]),
    ([asks(("c", "load", {"n": 1}), said=f"{NOTE}."), answers("c", NOTE)], [("t2", "model_message")]),
    ([asks(("c", "load", {"n": 1})), answers("nobody", "Ten ships in the harbour")], [("t2", "unmatched")]),
    ([asks(("c", "find", {"q": "treaty of Vienna"})), answers("c", "A page of text on many other things and the treaty of Vienna, among them cats and dogs")], []),
])
def test_notes_on_replies_that_repeat_the_model(messages, want):
    got, run = noted(*messages)
    assert got == want
    assert all(kinds(run)[i] == "tool_result" for i, _ in got)


def test_a_declaration_clears_notes_and_says_so():
    messages = [asks(("c", "save", {"note": NOTE})), answers("c", f"Stored today {NOTE} it says\nfine")]
    got, run = noted(*messages, external_tools=frozenset({"Save", "other"}))
    assert got == [] and [(n["kind"], n["cleared_by"]) for n in run["_meta"]["cleared_notes"]] == [("answering_call", "Save")]
    assert run["_meta"]["declarations_not_in_log"] == ["other"] and run["_meta"]["undeclared"] == []


def test_replies_without_a_call_of_their_own():
    two = [asks(("", "save", {"note": NOTE}), ("", "think", {"x": "y"})), {"role": "tool", "content": NOTE}, {"role": "tool", "content": "A page from elsewhere"}]
    assert kinds(noted(*two)[1])["t2"] == "intermediate"
    _, run = noted(*two, model_text_tools=frozenset({"think"}))
    assert kinds(run)["t3"] == "intermediate" and run["_meta"]["unresolved"]


@pytest.mark.parametrize("reply, arguments, yes", [
    ("Canberra.", {"city": "Canberra"}, True), ('"Canberra"', {"city": "Canberra"}, True), ('{"saved": true, "text": "a note of mine"}', {"note": "a note of mine"}, True),
    ('{"id": 4, "type": "Buy"}', {"side": "Buy"}, False), ("Saved: a note of mine", {"note": "a note of mine"}, True), ("12", "final_answer(12)", True), ("e", {"x": "apple e"}, True),
    ("A page\nwith e\ne", {"x": "apple e"}, False), ("x", '{"cols": {"x": 1}}', False), ("a\u00a0note\u200b of mine", {"note": "a note of mine"}, True), ("caf\\u00e9 noir", {"n": "café noir"}, True),
])
def test_a_value_handed_back(reply, arguments, yes):
    assert echoes.is_a_value(reply, arguments if isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)) is yes


def test_shares_are_those_of_a_plain_search():
    r = random.Random(3)
    for _ in range(300):
        texts = [[r.choice(("aaaa", "bbbb", "cccc", "dd")) for _ in range(r.randint(1, 9))] for _ in range(r.randint(1, 4))]
        written = echoes.Written()
        for t in texts:
            written.add(" ".join(t))
        reply = [r.choice(("aaaa", "bbbb", "cccc", "dd", "eeee")) for _ in range(r.randint(1, 9))]
        k = covered = 0
        while k < len(reply):
            end = k
            while end < len(reply) and any(t[i : i + end + 1 - k] == reply[k : end + 1] for t in texts for i in range(len(t))):
                end += 1
            n = sum(map(len, reply[k:end]))
            covered += n if n >= echoes.RUN_CHARS else 0
            k = max(end, k + 1)
        assert abs(written.share(" ".join(reply))[0] - covered / sum(map(len, reply))) < 1e-9


def test_trajectory_echoes_and_labels():
    history = [
        {"step": 1, "content": "I will look", "tool_calls": [{"name": "search", "arguments": {"q": "the answer is Canberra"}}], "tool_responses": ["Canberra is a city\nthe answer is Canberra"]},
        {"step": 2, "tool_calls": [{"name": "final_answer", "arguments": "x"}], "tool_responses": ["something else"]},
        {"step": 3, "tool_calls": [{"name": "search"}], "tool_responses": ["z" * 30, "", None, {"a": 1}]},
    ]
    run = trajectory.to_run({"question": "Q?", "agent_answer": "the answer is Canberra", "hallucination_step": "3", "is_hallucination": "True", "history": history, "agent_type": "X-CodeAct"}, tool_chars=25)
    assert kinds(run) == {"question": "document", "s1": "intermediate", "s1.t0": "tool_result", "s2.t0": "intermediate", "s3.t0": "tool_result", "s3.t3": "tool_result", "answer": "final_answer"}
    meta = run["_meta"]
    assert meta["at_boundary"] and meta["code_agent"] and meta["labelled"] and meta["label_step"] == 3 and meta["truncated"] == ["s1.t0", "s3.t0"]
    assert meta["history_step_of"] == {"s1": 1, "s1.tools": 1, "s2.tools": 2, "s3.tools": 3}
    assert kinds(trajectory.to_run({"agent_answer": "the answer is Canberra", "history": history[:1]}))["s1.t0"] == "intermediate"


def span(at, given=None, gave=None, key="startTimeUnixNano", **more):
    part = lambda m: {"role": m[0], "parts": [{"type": "text", "content": m[1]}]} if m[0] else {"parts": [{"type": "text", "content": m[1]}]}
    value = lambda x: {"stringValue": x if isinstance(x, str) else json.dumps([part(m) for m in x])}
    found = [(k, v) for k, v in (("gen_ai.input.messages", given), ("gen_ai.output.messages", gave)) if v is not None]
    return {key: at, "attributes": [{"key": k, "value": value(v)} for k, v in found]} | more


def test_spans_that_are_cut_old_or_rewritten():
    u, a, b = ("user", "How tall is it?"), ("assistant", "Let me look."), ("assistant", "It is tall.")
    old = {"resourceSpans": [{"instrumentationLibrarySpans": [{"spans": [span("9", [u, a], [b], key="start_time_unix_nano"), span(1, [u], [a], key="startTime")]}]}]}
    run = spans.to_run(old)
    assert [x["content"] for x in run["artifacts"]] == [u[1], a[1], b[1]] and not run["_meta"]["rewritten"]
    cut = spans.to_run([span("1", [u], [a]), span("2", '[{"role": "us', [b], name="chat")])
    assert cut["_meta"]["unreadable"] == ["chat: gen_ai.input.messages"] and [x["content"] for x in cut["artifacts"]][-1] == b[1]
    window = spans.to_run([span("1", [u], [a]), span("2", [a, ("user", "And wide?")], [b])])
    assert window["_meta"]["rewritten"] and [x["content"] for x in window["artifacts"]] == [u[1], a[1], "And wide?", b[1]]
    other = spans.to_run([span("1", [u], [a]), span("2", [("system", "Be brief"), u, ("", "So")], [b])])
    assert other["_meta"]["dropped_repeat_turns"] == 1 and other["_meta"]["roleless_turns"] == 1
    assert kinds(other)[next(x["artifact_id"] for x in other["artifacts"] if x["content"] == "So")] == "intermediate"
    tool = {"name": "execute_tool look", "startTimeUnixNano": "2", "attributes": {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.call.result": "134 m"}}
    assert spans.to_run([span("1", [u], [a]), tool])["artifacts"][-1]["title"] == "look"
    with pytest.raises(native.Malformed):
        spans.to_run([{"name": "x", "attributes": []}])


def test_a_recording_that_stops_on_a_tool_has_no_answer(spark):
    rows = [("t", 0, "model_end", "a", "model", "Let me look.", None), ("t", 1, "tool_start", "b", "look", "x", None), ("t", 2, "tool_end", "b", "look", "134 m", None)]
    schema = [f.split(" ")[0] for f in recorder.EVENTS.split(", ")] if isinstance(recorder.EVENTS, str) else recorder.EVENTS.names
    by = dict(zip(("trace_id", "seq", "event", "call_id", "name", "text", "documents"), zip(*rows, strict=True), strict=True))
    events = spark.createDataFrame([tuple(by[c][k] for c in schema) for k in range(3)], recorder.EVENTS)
    assert {r.kind for r in recorder.to_runs(events).artifacts.collect()} == {"intermediate", "tool_result"}


def test_what_is_not_posted_is_logged(spark):
    runs = fixtures.laundered(spark)
    said = {"segment": {}, "credit": {"It was designed by a local engineer.": [["page", "nowhere to be found"], ["figure", "x"], "odd", ["page", "The bridge was opened in 1932."]]}}
    posted, dropped, warnings = propose.post_with_log(runs, propose.scripted(said))
    got = sorted((r.claim_id, r.artifact_id, r.reason) for r in dropped.collect())
    assert [(a, why.split(" ")[0] + " " + why.split(" ")[-1]) for _, a, why in got if _.startswith("summary")] == [("", "credit pair"), ("figure", "artifact inputs"), ("page", "quote artifact")]
    assert warnings.count() == 0 and posted.entries.where("account LIKE 'EVIDENCE:page#0-30'").count() >= 1
    log = propose.Log()
    assert propose.ask(lambda *_: None, "segment", {}, log) == [] and len(log.warnings) == 2
    log = propose.Log()
    claim = {"claim_id": "c", "text": "unlike anything"}
    source = {"artifact_id": "a", "kind": "intermediate", "content": "One two three. Four five six."}
    assert propose.credit(claim, [source], {"a": [(0, 14)]}, lambda *_: [("a", "three. Four")], log)[0]["account"] == "PRIOR:model"
    assert [d["reason"] for d in log.dropped] == ["quote only partially overlaps claim a#0-14", "quote covers no whole claim of the artifact"]
    assert propose.credit(claim, [source], {"a": [(0, 14)]}, lambda *_: [("a", "One two three. Four five six.")], log)[0]["account"] == "EVIDENCE:a#0-14" and "11 characters" in log.warnings[0]
    assert propose.fence(["a << b", "c"]) == "<<<" and propose.fence(["x <<<< y"]) == "<<<<<"
