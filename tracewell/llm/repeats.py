"""Removal of long repeated byte strings: every byte covered by a string of LENGTH bytes that also starts earlier.

The corpus is dealt into run-length indexes small enough for a task. A window of LENGTH bytes is owned by the smallest
K-gram hash in it, hence equal windows are owned by equal K-grams; neighbouring windows with one owner are one span.
Of spans with equal bytes only the first stays open, and each task first settles what it holds itself, so a string
that all documents share reaches the shuffle once a task. Spans of one K-gram that differ meet in one index: their
run-compressed Burrows-Wheeler transform, with suffixes and common prefixes sampled at the heads of runs. From the
samples the matching statistics of every position are streamed (within a run each is one less than that before it),
windows that match for LENGTH bytes fall into classes, and the earliest of a class stays. The earliest is found among
a class's members, since run heads name any one start and not the first. K-grams with more spans than an index should
hold are compared window by window, by hashes that spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import added, keyed, mapped, mix64, plain, stored, table, texts, unmix64

LENGTH, K = 100, 32
#: Bytes that are hashed together, and rows that are settled together within a task.
BUFFER, FLUSH = 1 << 20, 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
#: Rows are kept narrow, since most of what is shuffled is these: `at` holds a start in its upper half, and in its
#: lower half a number times KINDS plus the kind of row.
_SPAN = "key long, s long, doc long, at long"
_OPEN, _MIXED, _APART, _DONE, _KINDS = 0, 1, 2, 3, 4
#: Spans of one K-gram that an index takes at most; those of more are compared by the hashes of their windows.
HOT = 1024
#: Parts that the spans of a K-gram are dealt in where K-grams with too many are looked up.
SALTS = 64
#: A byte that no UTF-8 text holds; it ends the spans in an index.
END = 255

_tables: dict[int, tuple] = {}


def _powers(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of an odd multiplier and of its inverse modulo 2^64."""
    if which not in _tables:
        rng = np.random.default_rng(77 + which)
        p = int(rng.integers(1, 2**62)) * 2 + 1
        size = 2 * BUFFER + 2 * LENGTH + 2

        def series(x: int) -> np.ndarray:
            out = np.full(size, x, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _tables[which] = (rng.integers(0, 2**63, 256, dtype=np.uint64), series(p), series(pow(p, -1, 2**64)))
    return _tables[which]


class Hashes:
    """Hashes of any substring of a buffer, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, buf: np.ndarray, which: int):
        values, power, self.inverse = _powers(which)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * power[: len(buf)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def buffers(items: Iterator[tuple[int, bytes]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts in them, ids, offsets in the documents) of texts put together; long ones are cut with an overlap of least - 1."""
    held, size = [], 0

    def done():
        raw = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        starts = np.cumsum([0, *(len(h[2]) for h in held)])
        return raw, starts, np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)

    for doc, raw in items:
        if len(raw) < least:
            continue
        for at in range(0, len(raw) - least + 1, BUFFER - least + 1):
            part = raw[at : at + BUFFER]
            if size + len(part) > BUFFER and held:
                yield done()
                held, size = [], 0
            held.append((doc, at, part))
            size += len(part)
    if held:
        yield done()


def spans(raw: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(part, first start, number of starts, K-gram hash, span hash) of the runs of windows with one owner."""
    h = Hashes(raw, 0)
    grams = h.grams(k)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(keys, length - k + 1) & _PLACE).astype(np.int64)
    valid = np.zeros(len(owner) + 1, np.int8)
    ends = starts[1:] - length + 1
    np.add.at(valid, starts[:-1], 1)
    np.add.at(valid, np.minimum(ends, len(owner)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = valid.copy()
    first[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    first[starts[:-1]] = True
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    hi = np.flatnonzero(last)
    n, p = hi - lo + 1, owner[lo]
    shape = ((p - lo) * 256 + n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.searchsorted(starts, lo, side="right") - 1, lo, n, grams[p], mix64(h.of(lo, hi + length) + shape)


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges [lo, hi) of documents, overlapping and touching ones made one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64) << 32
    reach = np.maximum.accumulate(hi + rank)
    first = np.flatnonzero(np.concatenate([[True], (lo + rank)[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], lo[first], reach[last] - rank[last]


def _rows(names_types: list[tuple[str, pa.DataType]], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names_types, strict=True)], [n for n, _ in names_types])


_SPAN_TYPES = [("key", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())]


def _i64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _settle(a: np.ndarray, s: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """What a task can settle of its own spans: of equal ones only the first goes on, the rest is done."""
    order = np.lexsort((lo, doc, s, a))
    a, s, doc, lo, n = (x[order] for x in (a, s, doc, lo, n))
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_a.copy()
    new[1:] |= s[1:] != s[:-1]
    d, b, e = merged(doc[~new], lo[~new], lo[~new] + n[~new] + length - 1)
    if len(d):
        zero = np.zeros(len(d), np.int64)
        yield _rows(_SPAN_TYPES, _i64(mix64(d.astype(np.uint64) + b.astype(np.uint64))), zero, d, b << 32 | (e - b) * _KINDS + _DONE)
    new_a = new_a[new]
    a, s, doc, lo, n = (x[new] for x in (a, s, doc, lo, n))
    group = np.cumsum(new_a) - 1
    mixed = (np.bincount(group) > 1)[group]
    kind = np.where(~mixed, _OPEN, np.where(new_a, _MIXED, _APART))
    key = np.where(kind == _APART, mix64(a ^ s), a)
    yield _rows(_SPAN_TYPES, _i64(key), _i64(s), doc, lo << 32 | n * _KINDS + kind)


def _find(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                    yield doc, text.encode("utf-8", "replace")

        held, size = [], 0
        for raw, starts, ids, offsets in buffers(items(), length):
            part, lo, n, a, s = spans(raw, starts, length, k)
            held.append((a, s, ids[part], lo - starts[part] + offsets[part], n))
            size += len(lo)
            if size >= FLUSH:
                yield from _settle(*(np.concatenate(x) for x in zip(*held, strict=True)), length)
                held, size = [], 0
        if held:
            yield from _settle(*(np.concatenate(x) for x in zip(*held, strict=True)), length)

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no key goes over an end."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        keys = t.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


#: gram: the K-gram hash of spans that are compared further.
_RANGE = "doc long, lo int, n int, kind int, gram long"
_RANGE_TYPES = [("doc", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("kind", pa.int32()), ("gram", pa.int64())]


def _resolve(length: int):
    """Spans sorted by key: done byte ranges, and the spans whose windows must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches, "key"):
            key, s, doc, at = (t.column(c).to_numpy() for c in ("key", "s", "doc", "at"))
            order = np.lexsort((at, doc, s, key))
            key, s, doc, at = (x[order] for x in (key, s, doc, at))
            low = at & 0xFFFFFFFF
            lo, n, kind = at >> 32, low // _KINDS, low % _KINDS
            done = kind == _DONE
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key.copy()
            new[1:] |= s[1:] != s[:-1]
            new |= done
            again = ~new & ~done
            d, b, e = merged(np.concatenate([doc[done], doc[again]]), np.concatenate([lo[done], lo[again]]), np.concatenate([lo[done] + n[done], lo[again] + n[again] + length - 1]))
            group = np.cumsum(new_key) - 1
            mixed = (np.bincount(group, new & ~done) > 1) | (np.bincount(group, (kind == _MIXED) | (kind == _APART)) > 0)
            some = new & ~done & mixed[group]
            gram = key[some].view(np.uint64)
            gram = _i64(np.where(kind[some] == _APART, unmix64(gram) ^ s[some].view(np.uint64), gram))
            yield _rows(_RANGE_TYPES, np.concatenate([d, doc[some]]), np.concatenate([b, lo[some]]), np.concatenate([e - b, n[some]]), np.repeat([_DONE, _APART], [len(d), len(gram)]), np.concatenate([np.zeros(len(d), np.int64), gram]))

    return run


#: What meets in an index, by the K-gram hash `h1`: a span of a document, its first start `at`, its bytes in `body`.
#: Of hot K-grams, windows instead, without a body: a window's hash has 95 bits; `at` holds its last 31 in the upper
#: half and the window's start in the lower. n: 0 for these, else the bytes of a range that is done.
_PART = "h1 long, at long, doc long, n int, body binary"
_PART_TYPES = [("h1", pa.int64()), ("at", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("body", pa.binary())]


def _bare(h1: np.ndarray, at: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip((h1, at, doc, n), _PART_TYPES, strict=False)), pa.nulls(len(h1), pa.binary())], [n for n, _ in _PART_TYPES])


def _ranges_of(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _parts(length: int):
    """(doc, text, found) as the spans' bytes, or the windows of hot ones; of equal windows in a task only the first goes on."""

    def settle(h1, h2, doc, lo) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((lo, doc, h2, h1))
        h1, h2, doc, lo = (x[order] for x in (h1, h2, doc, lo))
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        d, b, e = merged(doc[~new], lo[~new], lo[~new] + length)
        yield _bare(_i64(mix64(d.astype(np.uint64) + b.astype(np.uint64))), b, d, e - b)
        yield _bare(_i64(h1[new]), h2[new] << 32 | lo[new], doc[new], np.zeros(int(new.sum()), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found = batch.column(2)
            cuts, values = found.offsets.to_numpy(), found.values
            fields = [values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "gram", "hot")]
            for j, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)):
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                lo, n, gram, hot = (x[cuts[j] : cuts[j + 1]] for x in fields)
                lo, n = lo.astype(np.int64), n.astype(np.int64)
                cool = np.flatnonzero(~hot)
                for k in range(0, len(cool), FLUSH // 64):
                    own = cool[k : k + FLUSH // 64]
                    wide = n[own] + length - 1
                    ends = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(raw[_ranges_of(lo[own], wide)])])
                    yield pa.RecordBatch.from_arrays([pa.array(gram[own], pa.int64()), pa.array(lo[own], pa.int64()), pa.array(np.full(len(own), doc), pa.int64()), pa.array(n[own], pa.int32()), body], [c for c, _ in _PART_TYPES])
                if not hot.any():
                    continue
                order = np.flatnonzero(hot)[np.argsort(lo[hot], kind="stable")]
                at = _ranges_of(lo[order], n[order])
                for base in range(0, len(raw), BUFFER):
                    own = at[(at >= base) & (at < base + BUFFER)]
                    if len(own):
                        part = raw[base : base + BUFFER + length]
                        h1, h2 = (Hashes(part, w).of(own - base, own - base + length) for w in (0, 1))
                        held.append((h1, (h2 >> np.uint64(33)).astype(np.int64), np.full(len(own), doc, np.int64), own))
                        size += len(own)
                if size >= FLUSH:
                    yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of byte strings that each end in END.

    Suffixes are sorted by prefix doubling; every END counts as a letter of its own, so no order or match goes over one.
    heads: the rows where a run of equal letters begins. Sampled there are the suffix and how many bytes it has in
    common with the one sorted before it; all other common prefixes follow from these.
    """

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        ends = text == END
        stop = np.flatnonzero(ends)
        self.left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)  # bytes up to the END
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = text
        #: Eight bytes from each place, those behind an END as zeros.
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | np.where(self.left >= k, padded[k : n + k], 0).astype(np.uint64)
        self.word = word
        self.order, self.place = self._sorted()
        letter = text[self.order - 1]
        head = np.ones(n, bool)
        head[1:] = (letter[1:] != letter[:-1]) | (letter[1:] == END)
        self.heads = np.flatnonzero(head)
        self.samples = self.order[self.heads]
        self.common = np.zeros(len(self.heads), np.int64)
        self.common[1:] = self._alike(self.order[self.heads[1:] - 1], self.samples[1:])

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and the place of each in it."""
        n = len(self.text)
        order = np.argsort(self.word, kind="stable")
        sure = self.left < 8  # an END is among the eight: no other suffix is the same, and of such the earlier is less
        new = np.ones(n, bool)
        word, own = self.word[order], sure[order]
        new[1:] = (word[1:] != word[:-1]) | own[1:] | own[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        reach = 8
        while True:
            alone = new & np.concatenate([new[1:], [True]])
            slots = np.flatnonzero(~alone)
            if not len(slots):
                return order, rank
            open_ = order[slots]
            key = rank[open_] << 32 | rank[np.minimum(open_ + reach, n - 1)]
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            order[slots] = open_
            fresh = np.ones(len(slots), bool)
            fresh[1:] = key[1:] != key[:-1]
            new[slots] = fresh
            rank[open_] = np.maximum.accumulate(np.where(fresh, slots, 0))
            reach *= 2

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common, neither counted over its END."""
        most = np.minimum(self.left[a], self.left[b])
        out, going, k = most.copy(), np.arange(len(a)), 0
        while len(going):
            x, y = self.word[a[going] + k], self.word[b[going] + k]
            apart = x != y
            # the first byte that differs, from the highest bit that does
            other = x[apart] ^ y[apart]
            bit = np.frexp(other.astype(np.float64))[1]  # too high by one where the number is rounded up to a power
            first = np.where(other >> np.uint64(56) == 0, np.maximum(1, 8 - -(-bit // 8)), 0)
            out[going[apart]] = np.minimum(out[going[apart]], k + first)
            k += 8
            going = going[~apart]
            going = going[most[going] > k]
        return out

    def statistics(self) -> np.ndarray:
        """For every place: how many bytes its suffix has in common with the one sorted before it.

        Streamed from the samples: inside a run the letter in front of both is the same, so the value is one less than
        that of the place before.
        """
        n = len(self.text)
        last = np.zeros(n, np.int64)
        last[self.samples] = self.samples
        last = np.maximum.accumulate(last)
        value = np.zeros(n, np.int64)
        value[self.samples] = self.common
        return np.maximum(value[last] + last - np.arange(n), 0)

    def repeats(self, length: int) -> np.ndarray:
        """Whether the string of `length` bytes at each place also starts at an earlier place."""
        n = len(self.text)
        first = self.statistics()[self.order] < length
        first[:1] = True
        least = np.minimum.reduceat(self.order, np.flatnonzero(first)) if n else self.order
        return (np.arange(n) > least[(np.cumsum(first) - 1)[self.place]]) if n else np.zeros(0, bool)


def _matched(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, lo, hi) of the windows of spans, all of their K-grams, that also start earlier."""
    gram, lo, doc, n = (t.column(c).to_numpy().astype(np.int64) for c in ("h1", "at", "doc", "n"))
    order = np.lexsort((lo, doc, gram))
    body = t.column("body").combine_chunks()
    body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
    starts, raw = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64), np.frombuffer(body.buffers()[2], np.uint8)
    lo, doc, n, starts = lo[order], doc[order], n[order], starts[:-1][order]
    wide = n + length  # with the END
    text = np.full(int(wide.sum()), END, np.uint8)
    at = np.cumsum(wide) - wide
    text[_ranges_of(at, wide - 1)] = raw[_ranges_of(starts, wide - 1)]
    again = RunIndex(text).repeats(length)
    span = np.repeat(np.arange(len(n)), n)
    place = _ranges_of(at, n)
    own = again[place]
    start = lo[span[own]] + place[own] - at[span[own]]
    return doc[span[own]], start, start + length


def _compare(length: int):
    """Parts sorted by h1: the byte ranges of all but the first of equal windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches, "h1"):
            bare = t.column("body").is_null().to_numpy()
            found = []
            if not bare.all():
                found.append(_matched(t.filter(pa.array(~bare)), length))
            if bare.any():
                h1, at, doc, n = (t.column(c).to_numpy().astype(np.int64)[bare] for c in ("h1", "at", "doc", "n"))
                h2, lo = at >> 32, at & 0xFFFFFFFF
                order = np.lexsort((lo, doc, h2, h1))
                h1, h2, doc, lo, n = (x[order] for x in (h1, h2, doc, lo, n))
                done = n > 0
                again = ~(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) | done)
                found += [(doc[done], lo[done], lo[done] + n[done]), (doc[again], lo[again], lo[again] + length)]
            d, b, e = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield _rows(_RANGE_TYPES, d, b, e - b, np.full(len(d), _DONE), np.zeros(len(d), np.int64))

    return run


#: Holds for every row; said so that both joins with the documents are planned alike and share their exchange.
_KEY = "doc is not null"


def repeated(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc, ranges) of docs(doc, text, ...): an array of (lo, n): byte ranges that cover all repeats and may overlap. A
    document without repeats has no row. All columns of docs take part in the join, so that the caller's own join of
    docs with the result uses the same exchange."""
    found = mapped(docs.select("doc", "text"), _find(length, k), _SPAN)
    found = stored(mapped(found.repartition("key").sortWithinPartitions("key"), _resolve(length), _RANGE))
    salt = F.pmod(F.xxhash64("doc", "lo"), F.lit(SALTS)).alias("salt")
    apart = found.where(F.col("kind") == _APART).select("doc", "lo", "n", "gram", salt)
    many = apart.groupBy("gram").agg(F.count("*").alias("spans")).where(F.col("spans") > hot)
    many = many.select("gram", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("hot"))
    apart = apart.join(many, ["gram", "salt"], "left").select("doc", "lo", "n", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))
    apart = apart.groupBy("doc").agg(F.collect_list(F.struct("lo", "n", "gram", "hot")).alias("found"))
    parts = mapped(docs.join(apart.hint("shuffle_hash"), "doc").select("doc", "text", "found", *(c for c in docs.columns if c not in ("doc", "text"))), _parts(length), _PART)
    more = mapped(parts.repartition("h1").sortWithinPartitions("h1"), _compare(length), _RANGE)
    return found.where(F.col("kind") == _DONE).union(more).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))


def _cover(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges [lo, hi)."""
    out: list[tuple[int, int]] = []
    for lo, n in sorted((x["lo"], x["n"]) for x in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], lo + n))
        else:
            out.append((lo, lo + n))
    return out


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs(doc_id, text), a row for every row.

    Null text: empty. A repeated row is removed but for its first; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        for b in batches:
            out = []
            for doc, text, ranges in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                raw, cover, h, at = text.encode("utf-8", "replace"), _cover(ranges), hashlib.sha256(), 0
                for lo, hi in cover:
                    h.update(raw[at:lo])
                    at = hi
                h.update(raw[at:])
                out.append((doc, len(raw), sum(hi - lo for lo, hi in cover), len(cover), h.hexdigest()))
            yield _rows(types, *(list(zip(*out, strict=True)) or [[]] * 5))

    docs = keyed(docs.select(F.col("doc_id").cast("long"), "text")).withColumnRenamed("_row", "doc").where(_KEY)
    ranges = repeated(docs, length)
    both = docs.join(ranges.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "ranges")
    return mapped(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeats cut out of `text` (and `n_chars`, if it is there, counted anew); all rows and columns stay.

    A character goes only if all its bytes do. Null texts stay null; repeated rows lose their texts but for the first;
    an empty table gives an empty one; other columns may have any names.
    """
    wide = plain(docs, "doc_id", "text")
    at, names = wide.columns.index("text"), wide.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, cut = [], []
            for text, ranges in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                cut.append(bool(ranges))
                if not ranges:
                    out.append(text)
                    continue
                raw, kept, end = text.encode("utf-8", "replace"), [], 0
                for lo, hi in _cover(ranges):
                    while lo < hi and raw[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                        hi -= 1
                    kept.append(raw[end:lo])
                    end = hi
                out.append(b"".join([*kept, raw[end:]]).decode("utf-8", "replace"))
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.bool_())], [*names, "cut"])

    rows = keyed(wide).withColumnRenamed("_row", "doc").where(_KEY)
    both = rows.join(repeated(rows, length).hint("shuffle_hash"), "doc", "left").select(*names, "ranges")
    done = mapped(both, run, added(wide, cut=T.BooleanType()))
    if "n_chars" in docs.columns:
        k = docs.columns.index("n_chars")
        done = done.withColumn(names[k], F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names[k])))
    return done.select(*names).toDF(*docs.columns)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
