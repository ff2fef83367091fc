import hashlib
import random
import struct
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import fingerprint

TEXTS = {7: "alpha beta gamma delta", 5: "alpha beta gamma delta", 4: "", 3: None, 2: "!!! ???", 1: "émile 😀 zola wrote long novels", 0: "one two"}


def test_compare(spark):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in TEXTS.items()], "doc_id long, text string, fp string, `range` int")
    rows = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    assert set(rows) == set(TEXTS)
    order = sorted(TEXTS, reverse=True)
    for k, i in enumerate(order):
        text, after = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[7].fingerprint == rows[5].fingerprint and rows[7].near_next == 1
    assert rows[4].fingerprint == rows[3].fingerprint != rows[2].fingerprint


def test_next_over_many_ranges(spark):
    n = 1000
    docs = spark.range(n).selectExpr("id * 3 AS doc_id", "CAST(id AS string) AS text")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"]).collect()}
    assert got == {3 * k: str((k - 1) % n) for k in range(n)}


def test_one_and_none(spark):
    one = fingerprint.compare(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprint.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    assert fingerprint.compare(docs).count() == 4


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    plan = fingerprint.compare(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def xx(value, seed=42):
    """Spark's xxhash64 of a string or of a number of `size` bytes, as an unsigned number."""
    return xxhash.xxh64_intdigest(value, seed=seed)


def folded(numbers):
    h = 42
    for n in numbers:
        h = xx(struct.pack("<q", n), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(rows, low=fingerprint.LOW, high=fingerprint.HIGH):
    """I-Match in plain Python: (fingerprint, edited fingerprint, near_edited, near_next) by doc_id."""
    terms = lambda t: {signed(xx(w.encode())) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    df = Counter(w for _, t in rows for w in terms(t))
    band = {w for w, n in df.items() if low * len(rows) <= n <= high * len(rows)}

    def sign(text):
        kept = sorted(terms(text) & band or terms(text) or {signed(xx(text.encode()))})
        subs = [[h for h in kept if xx(struct.pack("<i", j), xx(struct.pack("<q", h))) % fingerprint.RATE == 0] for j in range(fingerprint.SUBSETS)]
        return folded(kept), [folded(s) if s else None for s in subs]

    def near(a, b):
        if a[0] == b[0]:
            return 1.0
        held = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in held) / len(held) if held else 0.0

    text = lambda f: f"{f[0]:016x}:" + ".".join("-" if s is None else f"{s:016x}"[-8:] for s in f[1])
    order, out = sorted(rows, reverse=True), {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        a, e, n = sign(t), sign(t[: len(t) - half] + after[:half]), sign(after)
        out[i] = (text(a), text(e), near(a, e), near(a, n))
    return out


def test_every_column_against_plain_python(spark):
    r = random.Random(3)
    words = [f"w{k}" if k % 7 else f"é{k}" for k in range(300)]
    texts = [" ".join(r.choice(words[: r.choice([5, 40, 300])]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    texts += [texts[3], "", "!!", "only unseen words here", "x " * 3000]
    rows = [(i * i, t) for i, t in enumerate(texts)]
    got = {q.doc_id: (q.fingerprint, q.edited_fingerprint, q.near_edited, q.near_next) for q in fingerprint.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(abs(got[i][k] - want[i][k]) < 1e-12 for i in want for k in (2, 3))
    assert len({x[0] for x in want.values()}) > 100


def test_ids_far_apart(spark):
    ids = [-(2**63), -5, 0, 1, 2, 3, 2**62, 2**63 - 1]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"]).collect()}
    assert got == {b: str(a) for a, b in zip(ids, ids[1:], strict=False)} | {ids[0]: str(ids[-1])}
    many = spark.range(2000).selectExpr("CASE WHEN id = 7 THEN 9223372036854775807 ELSE id END AS doc_id", "CAST(id AS string) AS text")
    spread = fingerprint.with_next(many, ["text"])
    many_ = many.withColumn("hash", F.xxhash64("text"))
    assert many_.withColumn("range", fingerprint._range(many_)).groupBy("range").count().agg({"count": "max"}).first()[0] <= 4 * fingerprint.RANGE_ROWS
    assert {r.doc_id: r.next_text for r in spread.collect()}[8] == "6"


def test_null_ids_are_spread_and_last(spark):
    docs = spark.createDataFrame([(None, f"t{k}") for k in range(500)] + [(5, "five"), (9, "nine")], "doc_id long, text string")
    got = fingerprint.with_next(docs, ["text"]).collect()
    after = {r.text: r.next_text for r in got}
    assert len(got) == 502 and after["nine"] == "five" and sorted(after.values()) == sorted(after)
    at, seen = "nine", []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == 502
