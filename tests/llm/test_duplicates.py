import hashlib
import random

import numpy as np
import pytest

from tracewell.llm import common, common, embeddings, jaccard, repeats


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def corpus(seed=3, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 8])):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    r.shuffle(out)
    return [*out, "", None, "one two", "one two", "!!", "??", "ONE two", "three"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), *((100, k) for k in range(101, 160)), (159, 200), (200, 201)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **dict.fromkeys([*range(100, 160), 200, 201], 100)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard_join(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, id int, g string")
    shingle = jaccard.Shingler()
    sets = [set(shingle(t or "").tolist()) for t in texts]
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    links = np.bincount([x for p in pairs for x in p], minlength=n)
    want = {i: (c, links[i]) for i, c in enumerate(roots(n, pairs))}
    rows = jaccard.join(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == want and len(rows) == n
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()}


def test_jaccard_blocks(spark):
    """Blocks of a group that is larger than one block give the same links as a single block."""
    sets = [np.unique(np.arange(40) + 10 * (k // 3)).astype(np.uint64) for k in range(30)]
    whole = jaccard.linked(sets, None, 0.5)
    assert (whole[:12, 12:] == jaccard.linked(sets[:12], sets[12:], 0.5)).all() and (whole == whole.T).all()


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = jaccard.join(docs).collect()
    assert len(rows) == 4 and all(r.class_id == r.doc_id for r in rows)
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs).collect()
    assert sorted(map(tuple, kept), key=repr) == [(2, None), (None, "a b")]


def test_bands():
    bands, rows = jaccard.choose_bands()
    assert bands * rows <= jaccard.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def brute_repeats(texts, length=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if (w := raw[s : s + length]) in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=5):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abc é😀\n") for _ in range(n))
    shared = [text(r.randint(80, 260)) for _ in range(6)]
    out = ["a" * 350, "ab" * 200, "", None, text(99), text(100)]
    for _ in range(40):
        out.append("".join(r.choice([text(r.randint(0, 120)), r.choice(shared), r.choice(shared)[20:150]]) for _ in range(r.randint(1, 6))))
    return [*out, out[10], out[11], "a" * 350]


def test_repeats(spark, monkeypatch):
    texts = passages()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_long_texts_are_cut_with_an_overlap():
    r = np.random.default_rng(2)
    raw = bytes(r.integers(97, 100, 3 * repeats.BUFFER // 2, dtype=np.uint8))
    parts = list(repeats.buffers(iter([(1, raw), (2, b"x" * 150), (3, b"short")]), 100))
    windows = sum(max(0, int(b) - int(a) - 99) for _, starts, _, _ in parts for a, b in zip(starts, starts[1:], strict=False))
    assert windows == len(raw) - 99 + 51
    for buf, starts, ids, offsets in parts:
        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            if ids[k] == 1:
                assert bytes(buf[a:b]) == raw[offsets[k] : offsets[k] + b - a]


def test_repeats_keep_rows_and_whole_characters(spark):
    shared = "é" + "".join(chr(97 + k * k % 23) for k in range(110)) + "é"
    rows = [(1, shared + " one", "en", 116), (2, "zé" + shared, "en", 114), (2, "zé" + shared, "en", 114), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns
    out = sorted(got.collect(), key=repr)
    assert len(out) == 4 and all(r.text is None or r.n_chars == len(r.text) for r in out)
    assert sorted(r.text or "" for r in out) == ["", "", "zé", shared + " one"]
    assert repeats.without_repeats(docs.limit(0)).count() == 0 and repeats.digest(docs.limit(0)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(0)
    rows = []
    for g in range(60):
        c = r.normal(size=8)
        rows += [(len(rows) + k, (c + r.normal(size=8) * r.choice([0, 0.1, 0.25])).astype(np.float32).tolist(), int(g % 3)) for k in range(r.integers(1, 12))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] + [1.0] * 7, 1), (n + 3, rows[0][1], None), (n + 4, rows[0][1], rows[0][2]), (n + 5, [], 1), (n + 6, [1.0, None], 1), (n + 7, [float("inf")] * 8, 1)]
    ok = [v is not None and lab is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    x = np.array([np.array(v) / np.linalg.norm(v) if o else np.zeros(8) for (_, v, _), o in zip(rows, ok, strict=True)])
    hit = (x @ x.T >= 0.93) & (np.array([lab if lab is not None else -1 for *_, lab in rows])[:, None] == np.array([lab for *_, lab in rows])[None])
    np.fill_diagonal(hit, False)
    want = {i: (int(hit[i].sum()), c) for i, c in enumerate(roots(len(rows), np.argwhere(hit)))}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for cell in (2000, 20):
        got = embeddings.near_duplicates(table, cell=cell).collect()
        assert {q.vec_id: (q.n_links, q.component_id) for q in got} == want and len(got) == len(rows)
        assert all(q.kept == (q.vec_id == q.component_id) for q in got)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_lone_vectors_away_from_their_centroids_are_met(spark, monkeypatch):
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    monkeypatch.setattr(embeddings, "spherical_k_means", lambda x, k: np.array([at(0), at(60)]))
    table = lambda *degrees: spark.createDataFrame([(i, at(d), 0) for i, d in enumerate(degrees)], "vec_id long, embedding array<double>, label int")
    both = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table(29, 31), cell=1).collect()}
    assert both == {0: (1, 0), 1: (1, 0)}
    one = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table(29, 31, -20), cell=1).collect()}
    assert one == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_embeddings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 5))
    x = np.concatenate([base[k % 6] + r.normal(size=5) * 0.15 for k in range(120)]).reshape(120, 5)
    x[::10] *= 1e200
    x[1::10] *= 1e-200
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1), (None, None, 1)]
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.93
    np.fill_diagonal(hit, False)
    assert hit.any()
    want = {i: (int(hit[i].sum()), c) for i, c in enumerate(roots(120, np.argwhere(hit)))}
    for cell in (2000, 15):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=cell).collect()
        assert len(got) == 122 and all(not q.kept for q in got if q.vec_id is None)
        assert {q.vec_id: (q.n_links, q.component_id) for q in got if q.vec_id is not None} == want


def test_labels_without_centroids(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SAMPLE", 2)
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    rows = [(10 * lab + k, [1.0, 0.01 * k], lab) for lab in range(5) for k in range(9)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(q.n_links, q.vec_id - q.vec_id % 10 == q.component_id) for q in got} == {(8, True)} and len(got) == 45


def test_jaccard_groups_over_many_blocks_and_the_shuffled_branch(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(70):
        words = list(base)
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{r.randrange(10**6)}" for _ in range(50)) for _ in range(10)]
    sets = [set(jaccard.Shingler(5)(t).tolist()) for t in texts]
    hit = np.array([[i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    want = {i: (c, int(hit[i].sum())) for i, c in enumerate(roots(len(texts), np.argwhere(hit)))}
    rows = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {q.doc_id: (q.class_id, q.n_links) for q in rows} == want


def test_rows_that_share_an_id(spark):
    rows = [(2**62, "a b c d e f"), (2**62, "a b c d e f"), (2**62, "another text"), (None, "x"), (None, "y"), (-(2**63), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r._row: (r.doc_id, r.text) for r in common.keyed(docs).collect()}
    assert len(got) == 6
    assert [got[k][0] for k in sorted(got)] == [None, None, -(2**63), 2**62, 2**62, 2**62]
    assert sorted(map(repr, got.values())) == sorted(map(repr, rows))
    assert sorted(r.text for r in jaccard.keep_one(docs).collect()) == sorted({t for _, t in rows})
    assert repeats.digest(docs).count() == 6


def test_hot_grams_are_compared_by_windows(spark):
    """The same result whether the spans of a K-gram meet in an index or by their windows' hashes."""
    texts = passages()
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "doc long, text string").repartition(5)
    cover = lambda rows: {r.doc: repeats._cover([x.asDict() for x in r.ranges]) for r in rows}
    assert cover(repeats.repeated(docs, hot=0).collect()) == cover(repeats.repeated(docs, hot=10**9).collect()) != {}


@pytest.mark.parametrize("length", [1, 3, 8, 9, 20])
def test_run_index(length):
    r = random.Random(length)
    for _ in range(60):
        letters = r.choice([b"ab", b"abc\x00", bytes(range(250))])
        base = bytes(r.choice(letters) for _ in range(60))
        parts = [base[(k := r.randint(0, 50)) : k + r.randint(0, 40)] + bytes(r.choice(letters) for _ in range(r.randint(0, 10))) for _ in range(r.randint(1, 12))]
        text = b"".join(p + bytes([repeats.END]) for p in parts)
        seen, want = set(), []
        for i in range(len(text)):
            w = text[i : i + length]
            whole = len(w) == length and repeats.END not in w
            want.append(whole and w in seen)
            seen.add(w)
        index = repeats.RunIndex(np.frombuffer(text, np.uint8))
        assert index.repeats(length).tolist() == want
        suffixes = [(text[i : text.index(repeats.END, i)] + b"\xff", i) for i in range(len(text))]
        assert index.order.tolist() == [i for _, i in sorted(suffixes)]
