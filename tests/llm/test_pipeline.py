import pytest

import corpus_pipeline
from tests.llm.test_duplicates import passages
from tracewell.llm import jaccard, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    good, calm, single, cut, packed = kept[1:]
    assert all(x.columns == columns for x in kept[1:5])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept[:5]]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4]
    assert ids[1] == {r.doc_id for r in quality.op10_quality(spark, SF).where("predicted = 1").collect()}
    model = toxicity.fit(good.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[2] == {r.doc_id for r in toxicity.score(good, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert ids[3] == {r.class_id for r in jaccard.join(calm).collect()}
    lengths = [len(r.text) for r in cut.collect()]
    assert sum(lengths) <= sum(len(r.text) for r in single.collect()) and [r.n_chars for r in cut.collect()] == lengths
    assert {r.doc_id for r in packed.collect()} == ids[4]
    assert max(r["sum(length)"] for r in packed.groupBy("sequence_id").sum("length").collect()) <= packing.CAPACITY


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, tmp_path, stage):
    """Null and empty texts, null and repeated ids, very long texts, repeated rows, no rows, and clashing names."""
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    schema = "doc_id long, text string, score double, _row long, `range` int, ranges string, cut int, n_chars long"
    long = " ".join(f"word{k * 7919 % 30011}" for k in range(30_000))
    rows = [(1, None, 0.5, 1, 2, "x", 3, None), (2, "", 0.1, 1, 2, "x", 3, 0), (None, "A plain sentence of some words.", 0.1, 4, 2, None, 3, 31), (5, long, None, None, None, None, None, len(long)), (5, long, None, None, None, None, None, len(long)), (6, long + " end", 0.2, 0, 0, "", 0, 9)]
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, str(tmp_path))
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == got.columns
    out = got.collect()
    if stage is corpus_pipeline.best_fit_packing:
        assert {r.doc_id for r in out} == {1, 2, None, 5, 6} and sum(r.doc_id in (1, 2) for r in out) == 2
        return
    assert got.columns == docs.columns and all(r.score in (0.5, 0.1, 0.2, None) for r in out)
    if stage is corpus_pipeline.near_duplicates:
        assert sorted((r.doc_id or 0 for r in out)) == [0, 1, 5]
    if stage is corpus_pipeline.repeated_passages:
        assert len(out) == 6 and sorted(len(r.text) for r in out if r.doc_id == 5) == [0, len(long)] and [r.text for r in out if r.doc_id == 1] == [None]
        assert [len(r.text) for r in out if r.doc_id == 6][0] < 200


def test_repeated_passages_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(passages(seed=11))]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()}
    seen = set()
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        whole = "".join(c for c, (a, b) in zip(t or "", spans_of(t or ""), strict=True) if not all(gone[a:b]))
        assert got[i] == (None if t is None else whole)


def spans_of(text):
    at = 0
    for c in text:
        n = len(c.encode())
        yield at, at + n
        at += n
