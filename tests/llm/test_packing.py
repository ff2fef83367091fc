import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing

TEXTS = ["The quick, brown fox!", "", None, "x " * 300, "café CAFÉ İx Straße Σς", "It's 9a\x1cb <|endoftext|> 'tis", "The quick, brown fox!", "日本語 テスト"]


def lower_bound(lengths, capacity):
    return -(-sum(lengths) // capacity)


def test_ids_are_the_tokenizers():
    tok = Tokenizer.from_file(packing.tokenizer_path())
    enc = packing.WordIds(packing.tokenizer_path(), keep=10)
    for t in [t or "" for t in TEXTS] * 2:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plan_packs_all_within_capacity():
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(rng.pareto(1.2, 5000) * 60 + 1, 512).astype(int).tolist())
    plan = packing.plan(dict(counts), 512, rounds=20)
    got = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 512
        for x in lengths:
            got[x] += times
    assert got == counts
    assert sum(t for _, t in plan) <= 1.01 * lower_bound(list(counts.elements()), 512) + 1
    assert packing.plan({}, 512) == []


def test_every_length_is_covered_by_configurations():
    counts = Counter(np.random.default_rng(0).integers(64, 256, 3000).tolist())
    got, made = Counter(), packing.covering(dict(counts), 512)
    for pattern, times in made:
        assert times > 0 and sum(k * v for k, v in pattern.items()) <= 512
        got.update({k: v * times for k, v in pattern.items()})
    assert got == counts and len(made) <= 3 * len(counts)
    plan = sum(times for _, times in packing.plan(dict(counts), 512))
    assert plan == sum(times for _, times in made) <= sum(times for _, times in packing.best_fit(counts, 512)) - 10


def test_knapsack_of_what_is_left():
    assert packing.best_pattern(np.array([2, 3]), np.array([2.0, 3.0]), 11, np.array([1, 5])) == {3: 3, 2: 1}
    assert packing.best_pattern(np.array([2, 3]), np.array([2.0, 3.0]), 11, np.array([1, 2])) == {3: 2, 2: 1}


def test_pack(spark):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, length string, `offset` int")
    rows = packing.pack(docs, capacity=64, rounds=5).orderBy("doc_id", "piece").collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = [ids[k : k + 64] for k in range(0, len(ids), 64)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]] == [(k, 64 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(pieces)]
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_seq) == lower_bound([r.length for r in rows], 64)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), rounds=1).count() == 0


@pytest.mark.parametrize("lengths, values, capacity, best", [([3, 5], [3.0, 5.0], 11, 11), ([4], [1.0], 3, 0)])
def test_knapsack(lengths, values, capacity, best):
    found = packing.best_pattern(np.array(lengths), np.array(values), capacity)
    assert sum(k * v for k, v in found.items()) == best
