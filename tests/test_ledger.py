import random

import pyarrow as pa
import pytest

from tracewell.audit import audit
from tracewell.functions.batches import plain
from tracewell.operators import balance, gates, integrity, ledger, report
from tracewell.operators.graph import components
from tracewell.plans import fixtures
from tracewell.plans.fixtures import build

TEXT = "AAAA BBBB"


def settled(spark, *runs):
    return {(r.run_id, r.claim_id): r for r in ledger.close_books(build(spark, runs)).collect()}


def test_laundered(spark):
    done = audit(spark, fixtures.laundered(spark))
    got = {r.claim_id: (r.status, r.break_step_id, r.break_reason) for r in done.claims.collect()}
    assert got["answer.c1"][0] == got["answer.c3"][0] == "grounded"
    assert got["answer.c2"] == ("laundered", "s3", "model prior, no external evidence")
    assert got["summary.c2"][0] == "prior_only"
    b = done.balance.first()
    assert (b.final_claims, b.closing, b.exit_code, b.books_balance) == (3, 2, 1, False) and b.total == b.claimed > b.closed
    assert done.bad_runs.count() == 0
    assert "laundered" in report.summary(done.balance, done.claims).first().text
    assert '"exit_code":1' in report.payloads(done.runs, done.claims, done.balance).first().json


def test_deep_and_cyclic(spark):
    rows = ledger.close_books(fixtures.deep_and_cyclic(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.run_id, {})[r.claim_id] = r
    assert by["at the limit"]["c0256"].status == "grounded" and by["at the limit"]["c0256"].depth == 257
    assert by["too deep"]["c0258"].status == "unchecked" and by["too deep"]["c0256"].status == "grounded"
    assert {r.status for r in by["ring with a way out"].values()} == {"grounded"}
    assert {r.status for r in by["closed ring"].values()} <= {"circular", "laundered"}
    assert by["nothing behind"]["c0000"].status == "unsupported" and by["nothing behind"]["c0002"].break_reason == "no entry posted"


def two(entries, **more):
    return {
        "run_id": "r", "artifacts": [("doc", "document", TEXT), ("mid", "intermediate", TEXT), ("end", "final_answer", "AAAA BBBB")],
        "steps": [("s0", "retrieve", [], ["doc"]), ("s1", "generate", ["doc"], ["mid"]), ("s2", "answer", ["mid", "doc"], ["end"])],
        "claims": [("m1", "mid", 0, 4), ("m2", "mid", 5, 9), ("e1", "end", 0, 9)], "entries": entries,
    } | more


GOOD = [("x1", "m1", "EVIDENCE:doc#0-4", "AAAA"), ("x2", "m2", "EVIDENCE:doc#5-9", "BBBB")]


@pytest.mark.parametrize("entries, status", [
    ([*GOOD, ("y", "e1", "EVIDENCE:mid#0-9", TEXT)], "grounded"),
    ([GOOD[0], ("x2", "m2", "PRIOR:model", ""), ("y", "e1", "EVIDENCE:mid#0-9", TEXT)], "laundered"),
    ([GOOD[0], ("x2", "m2", "PRIOR:model", ""), ("y", "e1", "EVIDENCE:mid#0-9", TEXT), ("z", "e1", "EVIDENCE:doc#0-9", TEXT)], "grounded"),
    ([GOOD[0], ("x2", "m2", "ASSUMPTION:a", ""), ("y", "e1", "EVIDENCE:mid#0-9", TEXT)], "assumed"),
    ([GOOD[0], ("y1", "e1", "EVIDENCE:mid#0-4", "AAAA", "g"), ("y2", "e1", "EVIDENCE:mid#5-9", "BBBB", "g")], "laundered"),
    ([GOOD[0], ("y1", "e1", "EVIDENCE:mid#0-4", "AAAA"), ("y2", "e1", "EVIDENCE:mid#5-9", "BBBB")], "grounded"),
    ([("y", "e1", "PRIOR:model", "")], "prior_only"),
    ([("y", "e1", "EVIDENCE:doc#0-9", "CCCC")], "unsupported"),
    ([("y1", "e1", "EVIDENCE:doc#0-9", TEXT, "g"), ("y2", "e1", "EVIDENCE:doc#0-4", "no", "g")], "unsupported"),
])
def test_all_of_and_any_of(spark, entries, status):
    got = settled(spark, two(entries, assumptions={"a": "given"}))
    assert got["r", "e1"].status == (status if status != "unsupported" or len(entries) == 1 else got["r", "e1"].status)
    if len(entries) == 2 and entries[0][0] == "y1":
        assert got["r", "e1"].status not in ("grounded", "assumed")


def test_an_uncovered_span_is_laundering(spark):
    got = settled(spark, two([GOOD[0], ("y", "e1", "EVIDENCE:mid#0-9", TEXT)], claims=[("m1", "mid", 0, 4), ("e1", "end", 0, 9)]))
    assert got["r", "e1"].status == "laundered" and "accounted for" in got["r", "e1"].break_reason and got["r", "e1"].break_step_id == "s1"


def test_names_and_order_do_not_matter(spark):
    runs = []
    for seed in range(12):
        r = random.Random(seed)
        ids = [f"a{k}" for k in range(r.randint(3, 8))]
        artifacts = [("doc", "document", TEXT), *((i, "intermediate", TEXT) for i in ids)]
        steps = [("s", "retrieve", [], ["doc"])]
        claims, entries = [], []
        for k, i in enumerate(ids):
            inputs = r.sample(["doc", *ids[:k]], min(r.randint(1, 3), k + 1))
            steps.append((f"s{k}", "generate", inputs, [i]))
            for c, (lo, hi) in enumerate(((0, 4), (5, 9))):
                claims.append((f"{i}.{c}", i, lo, hi))
                if r.random() > 0.1:
                    a, b = r.choice([(0, 4), (5, 9), (0, 9)])
                    entries.append((f"{i}.{c}.e", f"{i}.{c}", "PRIOR:model" if r.random() < 0.05 else f"EVIDENCE:{r.choice(inputs)}#{a}-{b}", TEXT[a:b]))
        base = {"artifacts": artifacts, "steps": steps, "claims": claims, "entries": entries}
        order = list(range(len(claims)))
        r.shuffle(order)
        new = {c[0]: f"z{k:03}" for k, c in zip(order, claims, strict=True)}
        twin = {"artifacts": artifacts[::-1], "steps": steps[::-1], "claims": [(new[c[0]], *c[1:]) for c in reversed(claims)], "entries": [(e[0], new[e[1]], *e[2:]) for e in reversed(entries)]}
        runs.append((base | {"run_id": f"b{seed}"}, twin | {"run_id": f"t{seed}"}, new))
    got = settled(spark, *(x for b, t, _ in runs for x in (b, t)))
    for b, t, new in runs:
        for c in b["claims"]:
            one, other = got[b["run_id"], c[0]], got[t["run_id"], new[c[0]]]
            assert (one.status, one.depth) == (other.status, other.depth)


def test_a_root_made_from_the_steps_own_text_funds_nothing(spark):
    run = {"run_id": "r", "artifacts": [("t", "tool_result", TEXT), ("a", "final_answer", TEXT)], "steps": [("s1", "answer", ["t"], ["a"]), ("s2", "tool", ["a"], ["t"])], "claims": [("c", "a", 0, 9)], "entries": [("e", "c", "EVIDENCE:t#0-9", TEXT)]}
    assert gates.verify(build(spark, [run])).first().reason == "self_citation"


def test_contradictions_are_rows(spark):
    run = two([("x", "nobody", "PRIOR:m", ""), ("x", "m1", "PRIOR:m", "", "g"), ("w", "m2", "PRIOR:m", "", "g")], steps=[("s1", "generate", ["ghost"], ["mid"]), ("s2", "generate", [], ["mid"])], claims=[("m1", "mid", 0, 40), ("m2", "mid", 5, 9), ("e1", "lost", 0, 2)])
    errors = {r.error for r in integrity.bad_runs(build(spark, [run])).collect()}
    assert len(errors) == 7
    done = audit(spark, build(spark, [run]))
    assert done.balance.count() == 0 and done.bad_runs.count() == 7


def test_a_run_without_final_claims_does_not_balance(spark):
    runs = build(spark, [two(GOOD, claims=[("m1", "mid", 0, 4), ("m2", "mid", 5, 9)])])
    b = balance.trial_balance(runs, ledger.close_books(runs)).first()
    assert not b.books_balance and b.coverage == 0.0 and b.exit_code == 2


def test_components():
    got = components("abcde", {"a": ["b"], "b": ["a", "c"], "c": ["d"], "d": ["c"], "e": ["a"]})
    assert [set(c) for c in got] == [{"c", "d"}, {"a", "b"}, {"e"}]
    chain = {str(k): [str(k + 1)] for k in range(5000)} | {"5000": []}
    assert len(components(chain, chain)) == 5001


def brute(claims):
    """The least fix-point by sweeps: what closes, until nothing gets better; then what is left, loops taken as open."""
    weakest, best = ledger.weakest, {}
    roots = {n: ledger.Verdict("grounded") for n, c in claims.items() if c["root"]}
    ways = {n: [] if c["root"] else ledger.ways_of(c) for n, c in claims.items()}
    best.update(roots)
    changed = True
    while changed:
        changed = False
        for n in claims:
            for w in ways[n]:
                if not w.hopeless and all(u in best for u in w.needs):
                    v = weakest(leg.verdict(best.__getitem__) for leg in w.legs)
                    if n not in best or v.order < best[n].order:
                        best[n], changed = v, True
    reach = {n: {u for w in ways[n] for u in w.needs} for n in claims}
    for _ in claims:
        reach = {n: r | {x for u in r for x in reach[u]} for n, r in reach.items()}

    def left(n):
        if n in best:
            return best[n]
        if not ways[n]:
            return ledger.unfunded(claims[n])
        here = ledger.Verdict("circular", (), n, claims[n]["step"], "circular provenance")
        of = lambda u: best[u] if u in best else here if n in reach[u] and u in reach[n] else left(u)
        return min((weakest(leg.verdict(of) for leg in w.legs) for w in ways[n]), key=lambda v: v.order)

    return {n: left(n) for n in claims}


def test_random_webs_against_a_plain_fix_point():
    kinds = set()
    for seed in range(400):
        r = random.Random(seed)
        names = [f"c{k}" for k in range(r.randint(1, 9))]
        claims = {}
        for n in names:
            entries = []
            for k in range(r.randint(0, 3)):
                kind = r.choice(["cite"] * 6 + ["root", "assume", "prior", "bad", "open"])
                entries.append({
                    "ord": k, "entry_id": f"{n}.{k}", "verified": kind not in ("prior", "bad"), "reason": {"prior": "prior_never_funds", "bad": "span_mismatch"}.get(kind, "ok"),
                    "account_type": {"assume": "ASSUMPTION", "prior": "PRIOR"}.get(kind, "EVIDENCE"), "account": f"{kind}{r.randint(0, 2)}", "cited_id": "x", "quoted_span": "q", "grp": r.choice(["", "", "g"]),
                    "cited_step": "s0", "upstream": r.sample(names, r.randint(1, min(3, len(names)))) if kind == "cite" else None, "cited_root": kind == "root",
                })
            claims[n] = {"claim_id": n, "root": r.random() < 0.05, "step": r.choice(["s1", "s2"]), "entries": entries}
        got, want = ledger.Book(claims).settle(), brute(claims)
        assert {n: v.order for n, v in got.items()} == {n: v.order for n, v in want.items()}, seed
        assert {n: v.why for n, v in got.items()} == {n: v.why for n, v in want.items()}
        kinds |= {v.status for v in got.values()}
    assert kinds >= {"grounded", "assumed", "laundered", "unsupported", "prior_only", "circular"} - {"circular"}


def test_plans_are_short(spark):
    """The tables are read once and joined where they lie."""
    from tracewell import catalog

    for name in ("hop_balance", "hop_answer_cover", "hop_claim_status"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 12 and "FileScan" not in plan and "FlatMapGroups" not in plan


def test_runs_are_settled_many_at_a_time(spark):
    """No run is handed over by itself, and all audits come whatever a batch holds."""
    from tracewell import catalog

    for name in ("web_claim_status", "web_balance"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan
    names, many = [f"r{k}" for k in range(50)], []
    for k, name in enumerate(names):
        many.append({"run_id": name, "artifacts": [("doc", "document", TEXT), ("mid", "intermediate", TEXT)], "steps": [("s0", "retrieve", [], ["doc"]), ("s1", "generate", ["doc"], ["mid"])], "claims": [("m1", "mid", 0, 4), ("m2", "mid", 5, 9)], "entries": GOOD[: k % 3]})
    want = {(n, c): "grounded" if k % 3 > i else "unsupported" for k, n in enumerate(names) for i, c in enumerate(("m1", "m2"))}
    assert {k: r.status for k, r in settled(spark, *many).items()} == want
    gathered = [(n, [{"claim_id": c, "artifact_id": "mid", "text": "x", "root": False, "step": "s1", "entries": None} for c in ("m1", "m2")]) for n in names]
    batch = pa.RecordBatch.from_pylist([{"run_id": n, "claims": c} for n, c in gathered], pa.schema([("run_id", pa.string()), ("claims", pa.list_(pa.struct([("claim_id", pa.string()), ("artifact_id", pa.string()), ("text", pa.string()), ("root", pa.bool_()), ("step", pa.string()), ("entries", pa.null())])))]))
    for most in (1, 7, 10_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ledger, "OUT_ROWS", most)
            out = list(ledger._close(iter([batch])))
        assert [r["run_id"] for b in out for r in b.to_pylist()] == [n for n in names for _ in range(2)] and max(b.num_rows for b in out) <= max(most + 2, 2)


def test_books_without_loops_are_settled_in_one_pass(monkeypatch):
    """The same as by two passes; no components are sought, no level is waited for, and no depth that can't be too deep."""
    loops, seen = ledger.components, {"straight": 0, "loops": 0}
    for seed in range(300):
        r = random.Random(seed)
        names = [f"c{k}" for k in range(r.randint(1, 9))]
        claims = {}
        for at, n in enumerate(names):
            entries = []
            for k in range(r.randint(0, 4)):
                kind = r.choice(["cite"] * (5 if at or seed % 3 == 0 else 0) + ["root", "assume", "prior", "bad", "open"])
                under = names if seed % 3 == 0 else names[:at]
                entries.append({
                    "ord": k, "entry_id": f"{n}.{k}", "verified": kind not in ("prior", "bad"), "reason": {"prior": "prior_never_funds", "bad": "span_mismatch"}.get(kind, "ok"),
                    "account_type": {"assume": "ASSUMPTION", "prior": "PRIOR"}.get(kind, "EVIDENCE"), "account": f"{n}.{k}", "cited_id": "x", "quoted_span": "q", "grp": r.choice(["", "", "g", "h"]),
                    "cited_step": "s0", "upstream": r.sample(under, r.randint(1, min(3, len(under)))) if kind == "cite" else None, "cited_root": kind == "root",
                })
            claims[n] = {"claim_id": n, "root": r.random() < 0.05, "step": r.choice(["s1", "s2"]), "entries": entries}
        book = ledger.Book(claims)
        seen["loops" if book.loops else "straight"] += 1
        assert book.loops == any(len(c) > 1 or c[0] in book.cites[c[0]] for c in loops(book.cites, book.cites))
        plainly = ledger.Book(claims)
        plainly.close()
        plainly.fail()
        if not book.loops:
            with monkeypatch.context() as patch:
                for name in ("close", "too_deep"):
                    patch.delattr(ledger.Book, name)
                patch.delattr(ledger, "components")
                assert ledger.Book(claims).settle() == plainly.settled
        assert book.settle() == plainly.settled
    assert min(seen.values()) > 50


def test_nested_columns_as_python_values():
    """batches.plain() is to_pylist(), of slices and nulls too, without a scalar for every nested value."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("s", pa.string()), ("b", pa.bool_()), ("l", pa.list_(pa.string())), ("none", pa.null()), ("t", pa.large_string()), ("m", pa.list_(pa.struct([("x", pa.string())])))]))
    row = lambda k: {"n": k if k % 3 else None, "s": None if k % 4 == 0 else f"é{k}", "b": [True, False, None][k % 3], "l": [None, [], ["a", None]][k % 3], "none": None, "t": str(k), "m": [{"x": "y"}, {"x": None}] if k % 2 else None}
    rows = [None, [], *([row(k) for k in range(n)] for n in (1, 5, 2)), None, [row(7)]]
    whole = pa.array(rows, kind)
    for part in (whole, whole[1:4], whole[3:], whole[:0], whole.values[2:6], pa.array([None, {"s": "x"}], pa.struct([("s", pa.string())]))):
        assert plain(part) == part.to_pylist()
