"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a lattice of vocabulary pieces. A path's weight is a sum: of piece scores for unigram models, and for BPE
models of 0 for neighbours that merging would leave apart and minus infinity for others; of all segmentations of a
text exactly one has weight 0 then, the one that merging by score gives. A giant text is cut into chunks. The piece
that lies over a cut is the state there; a chunk gives the matrix of the best weights from each state at its start to
each at its end. Matrices are combined associatively, which fixes the state at every cut, and each chunk is then
traced back on its own. A text of one chunk has one state at either end. Within a chunk, words that no piece leaves
are segmented once and remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Memo, added, grouped, mapped, stored, table, texts

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk; a longer text is giant.
CHUNK = 32_768
SPACE = "▁"
#: Pairs of pieces whose weight a worker remembers.
PAIRS = 300_000
#: Chunks whose matrices one task combines before a whole text's are put together.
BLOCK = 64
_FAR = float("-inf")
State = tuple[int, int]  # the piece over a cut (START at the beginning), and how far it reaches beyond it
START = -1
Matrix = dict[State, dict[State, float]]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a model whose normalisation is the identity, and the weights of its lattice."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            self._load(proto.ModelProto.FromString(f.read()))

    @classmethod
    def of(cls, model) -> Pieces:
        made = cls.__new__(cls)
        made._load(model)
        return made

    def _load(self, model) -> None:
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are read")
        self.prefix, self.bpe = spec.add_dummy_prefix, model.trainer_spec.model_type == 2
        self.texts = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.ids = {t: i for i, t in enumerate(self.texts) if kinds[i] == 1}
        self.longest = max(map(len, self.ids))
        self.unknown = kinds.index(2)
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if kinds[i] == 6}
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.surface = [bytes([int(t[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, kinds, strict=True)]
        #: Whether words can be cut in front of a space: no piece has one behind another character.
        self.by_words = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.stretch = self._stretches() if self.by_words else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self.word, self.sorted_words if self.bpe else None)

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def piece(self, s: str) -> int | None:
        """The id of a piece; for a single character that is none, a negative number that stands for it."""
        i = self.ids.get(s)
        return i if i is not None or len(s) > 1 else -2 - ord(s)

    def merged(self, text: str) -> list[str]:
        """The text after all merges: the best score first, the leftmost of equal ones. For short texts."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = _FAR, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves piece b behind piece a as they are."""
        if a < 0 or b < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.texts[a], self.texts[b]
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
        return known

    def alone(self, i: int) -> bool:
        """Whether merging makes this piece of its characters."""
        return self.apart_alone(i) if self.bpe and i >= 0 else True

    def apart_alone(self, i: int) -> bool:
        known = self.pairs.get((i, START))
        if known is None:
            known = self.pairs[i, START] = len(self.merged(self.texts[i])) == 1
        return known

    def weight(self, before: int, i: int) -> float:
        if self.bpe:
            return 0.0 if (self.apart(before, i) if before != START else self.alone(i)) else _FAR
        return self.scores[i] if i >= 0 else self.low

    def forward(self, text: str, at: int, before: int, end: int) -> tuple[list[int], list[int], list[float]]:
        """Best last piece, its start and the weight for every position from `at`; pieces start before `end`."""
        n = min(len(text), end + self.longest - 1) if end < len(text) else len(text)
        last, back, best = [START] * (n + 1), [-1] * (n + 1), [_FAR] * (n + 1)
        last[at], best[at] = before, 0.0
        ids, bpe, longest, get = self.ids, self.bpe, self.longest, self.pairs.get
        for e in range(at + 1, n + 1):
            for s in range(e - 1, max(at, e - longest) - 1, -1):
                w = best[s]
                if w == _FAR or s >= end:
                    continue
                i = ids.get(text[s:e])
                if i is None:
                    if s < e - 1:
                        continue
                    i = -2 - ord(text[s])
                b = last[s]
                if bpe:
                    ok = get((b, i)) if b >= 0 else None
                    if ok is None:
                        ok = self.weight(b, i) == 0.0
                    if ok:
                        last[e], back[e], best[e] = i, s, 0.0
                        break
                else:
                    w += self.weight(b, i)
                    if w > best[e]:
                        last[e], back[e], best[e] = i, s, w
        return last, back, best

    def written(self, found: list[int]) -> list[int]:
        """Ids, with the bytes of characters that are no pieces (or the unknown piece, where the model has no bytes)."""
        if all(i >= 0 for i in found):
            return found
        out: list[int] = []
        for i in found:
            out += [i] if i >= 0 else [self.bytes[b] for b in chr(-2 - i).encode("utf-8", "replace")] if self.bytes else [self.unknown]
        return out

    def trace(self, last: list[int], back: list[int], at: int, end: int) -> list[int]:
        found = []
        while end > at:
            found.append(last[end])
            end = back[end]
        return self.written(found[::-1])

    def word(self, word: str) -> bytes:
        last, back, _ = self.forward(word, 0, START, len(word))
        return np.array(self.trace(last, back, 0, len(word)), "<u4").tobytes()

    def sorted_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of sorted words by a BPE model: what two neighbours begin with is passed through once."""
        ids, pairs, longest, apart = self.ids, self.pairs, self.longest, self.apart
        last, back, before = [START], [-1], ""  # by place: the last piece of the prefix and its start (-1: no way there)
        for word in words:
            k = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                k += 1
            del last[k + 1 :], back[k + 1 :]
            for e in range(k + 1, len(word) + 1):
                found, at = START, -1
                for s in range(e - 1, max(0, e - longest) - 1, -1):
                    if s and back[s] < 0:
                        continue
                    i = ids.get(word[s:e])
                    if i is None:
                        if s < e - 1:
                            continue
                        i = -2 - ord(word[s])
                    if not s:
                        ok = self.alone(i)
                    else:
                        ok = pairs.get((last[s], i))
                        if ok is None:
                            ok = apart(last[s], i)
                    if ok:
                        found, at = i, s
                        break
                last.append(found)
                back.append(at)
            before = word
            yield np.array(self.trace(last, back, 0, len(word)), "<u4").tobytes()

    def encode_all(self, many: list[str]) -> list[bytes]:
        """encode() of many texts; the words that are new in them are segmented together."""
        parts = [(self.cut(s) if self.by_words else [s]) if s else [] for s in map(self.normal, many)]
        self.memo.learn({w for part in parts for w in part})
        return [b"".join(map(self.memo.__getitem__, part)) for part in parts]

    def encode(self, text: str) -> bytes:
        """The ids of a text of one chunk, as little-endian unsigned 32-bit integers."""
        s = self.normal(text)
        if not s:
            return b""
        return self.words(self.cut(s) if self.by_words else [s])

    def cut(self, s: str) -> list[str]:
        """Stretches of a text that no piece leaves."""
        return self.stretch.findall(s) if self.stretch else segments(s)

    def _stretches(self) -> re.Pattern | None:
        """Runs of letters and runs of others, with the spaces before them, if no piece holds both; numerals that
        pieces join to others count as others."""
        both = re.compile(f"[^\\W\\d_](?=[^{SPACE}])[\\W\\d_]|(?=[^{SPACE}])[\\W\\d_][^\\W\\d_]")
        joined = {c for t in self.ids for m in both.finditer(t) for c in m[0] if re.match(r"[^\W\d_]", c)}
        if any(c.isalpha() for c in joined):
            return None
        letter = "[^\\W\\d_" + re.escape("".join(sorted(joined))) + "]"
        found = re.compile(f"{SPACE}*{letter}+|{SPACE}*(?:(?!{letter})[^{SPACE}])+|{SPACE}+")
        return found if all(len(found.findall(t)) == 1 for t in self.ids) else None

    def words(self, words: list[str]) -> bytes:
        """The ids of words that no piece leaves, one after another."""
        return b"".join(self.memo.of(words))

    def surfaces(self, ids: np.ndarray) -> bytes:
        surface = self.surface
        return b"".join([surface[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become the replacement character; a leading dummy space goes."""
        out = self.surfaces(ids).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


_CUT = re.compile(f"[^{SPACE}](?={SPACE})")
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def segments(s: str) -> list[str]:
    """Runs of spaces with the word behind them."""
    return _SEGMENT.findall(s)


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def states(p: Pieces, text: str, cut: int) -> list[State]:
    """All pieces that can lie over a cut or end at it."""
    found: dict[State, None] = {}
    for s in range(max(0, cut - p.longest), cut):
        for e in range(cut, min(len(text), s + p.longest) + 1):
            i = p.piece(text[s:e])
            if i is not None:
                found[i, e - cut] = None
    return list(found)


def word_cuts(p: Pieces, text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first and the last place within (lo, hi) that no piece of a BPE model goes over, if there are two.

    Merging never crosses a space behind another character, so all paths meet there in one state, whatever precedes.
    """
    if not (p.bpe and p.by_words):
        return None
    a = next((m.start() + 1 for m in _CUT.finditer(text, max(0, lo)) if m.start() + 1 > lo), hi)
    b = hi - 1
    while b > a and not (text[b - 1 : b] not in ("", SPACE) and text[b : b + 1] == SPACE):
        b -= 1
    return (a, b) if a < b else None


def transfer(p: Pieces, text: str, lo: int, hi: int, first: bool, final: bool) -> Matrix:
    """The matrix of the chunk text[lo:hi]; text holds at least the longest piece more on either side, if there is any."""
    if sure := word_cuts(p, text, lo, hi):
        behind = transfer(p, text, sure[1], hi, True, final).get((START, 0), {})
        head = text[: sure[0]]
        ahead = [(START, 0)] if first else states(p, text, lo)
        return {s: dict(behind) for s in ahead if behind and lo + s[1] <= sure[0] and (lo + s[1] == sure[0] or p.forward(head, lo + s[1], s[0], sure[0])[2][sure[0]] > _FAR)}
    out: Matrix = {}
    done: list[tuple[list[int], list[float], dict[State, float]]] = []
    for i, reach in [(START, 0)] if first else states(p, text, lo):
        at = lo + reach
        if at > hi or final and at > len(text):
            out[i, reach] = {(i, reach - (hi - lo)): 0.0}
            continue
        same = None
        if done and p.bpe:
            # paths that agree over the longest piece agree for good
            probe = min(hi, at + 4 * p.longest)
            last, _, best = p.forward(text[: probe + p.longest], at, i, probe)
            for known, weights, row in done:
                if probe < hi and last[probe - p.longest + 1 : probe + 1] == known[probe - p.longest + 1 : probe + 1] and any(w > _FAR for w in weights[probe - p.longest + 1 : probe + 1]):
                    same = row
            if same is None and all(w == _FAR for w in best[max(at + 1, probe - p.longest + 1) : probe + 1]) and probe < hi:
                continue  # a dead end
        if same is None:
            last, back, best = p.forward(text, at, i, hi)
            same = {}
            for e in range(hi, min(len(best), hi + p.longest)):
                if best[e] > _FAR and (e == at or back[e] < hi) and not (final and e > hi):
                    same[last[e], e - hi] = best[e]
            done.append((last, best, same))
        if same:
            out[i, reach] = dict(same)
    return out


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: associative, so chunks may be combined in any grouping."""
    out: Matrix = {}
    for s, row in a.items():
        new: dict[State, float] = {}
        for mid, w in row.items():
            for e, v in b.get(mid, {}).items():
                if w + v > new.get(e, _FAR):
                    new[e] = w + v
        if new:
            out[s] = new
    return out


def cuts(matrices: list[Matrix], first: State = (START, 0), final: State | None = None) -> list[State]:
    """The states at the start of every chunk and at the end, of the best path from `first` (to `final`, if it is known)."""
    vectors: list[Matrix] = [{first: {first: 0.0}}]
    for m in matrices:
        vectors.append(combine(vectors[-1], m))
    weights = [next(iter(v.values()), {}) for v in vectors]
    if not weights[-1]:
        raise ValueError("a text has no segmentation")
    at = final or max(weights[-1], key=lambda s: (weights[-1][s], s))
    path = [at]
    for m, w in zip(matrices[::-1], weights[-2::-1], strict=True):
        at = max((s for s in w if at in m.get(s, {})), key=lambda s: (w[s] + m[s][at], s))
        path.append(at)
    return path[::-1]


def traced(p: Pieces, text: str, lo: int, hi: int, start: State, end: State) -> list[int]:
    """Ids of the pieces that start in the chunk, given the states at its cuts."""
    at = lo + start[1]
    if at > hi:
        return []
    if sure := word_cuts(p, text, lo, hi):
        a, b = sure
        last, back, _ = p.forward(text[:a], at, start[0], a)
        within = np.frombuffer(p.words(p.cut(text[a:b])), "<u4").tolist()
        return p.trace(last, back, at, a) + within + traced(p, text, b, hi, (START, 0), end)
    last, back, _ = p.forward(text, at, start[0], hi)
    return p.trace(last, back, at, hi + end[1])


def _chunks(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                s = p.normal(text)
                for k, lo in enumerate(range(0, len(s), chunk)):
                    hi, side = min(len(s), lo + chunk), p.longest
                    left = max(0, lo - side)
                    row = (key, k, s[left : hi + side], lo - left, hi - left, hi == len(s))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["key", "k", "part", "lo", "hi", "final"])

    return run


_MATRIX = "m array<struct<a:int,ar:int,b:int,br:int,w:double>>"
_MATRIX_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("ar", pa.int32()), ("b", pa.int32()), ("br", pa.int32()), ("w", pa.float64())]))


def _entries(m: Matrix) -> list[dict]:
    return [{"a": s[0], "ar": s[1], "b": e[0], "br": e[1], "w": w} for s, row in m.items() for e, w in row.items()]


def _matrix(entries: list[dict]) -> Matrix:
    m: Matrix = {}
    for x in entries:
        m.setdefault((x["a"], x["ar"]), {})[x["b"], x["br"]] = x["w"]
    return m


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            key, k, part, lo, hi, final = (c.to_pylist() for c in b.columns)
            rows = [_entries(transfer(p, part[j], lo[j], hi[j], k[j] == 0, final[j])) for j in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i // BLOCK for i in k], pa.int32()), pa.array(rows, _MATRIX_TYPE)], ["key", "k", "block", "m"])

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each block's matrices, sorted by (key, block, k)."""
    for t in grouped(batches, ["key", "block"]):
        m, *rest = map(_matrix, t.column("m").to_pylist())
        for x in rest:
            m = combine(m, x)
        yield pa.RecordBatch.from_arrays([pa.array([t.column("key")[0].as_py()], pa.string()), pa.array([t.column("block")[0].as_py()], pa.int32()), pa.array([_entries(m)], _MATRIX_TYPE)], ["key", "block", "m"])


def _states(by: str, inner: bool):
    """The states at either end of each row's stretch: of the blocks of a text, or of a block's chunks, whose outer
    states are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "block"] if inner else ["key"]):
            ends = [((t.column(a)[0].as_py()), t.column(r)[0].as_py()) for a, r in (("a0", "ar0"), ("b0", "br0"))] if inner else [(START, 0), None]
            path = np.array(cuts([_matrix(x) for x in t.column("m").to_pylist()], *ends), np.int32)
            cols = [t.column("key").combine_chunks(), t.column(by).combine_chunks(), *(pa.array(x, pa.int32()) for x in (path[:-1, 0], path[:-1, 1], path[1:, 0], path[1:, 1]))]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["key", by, "a", "ar", "b", "br"])

    return run


def _traces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            part, lo, hi, a, ar, e, er = (b.column(i).to_pylist() for i in range(2, 9))
            ids = [traced(p, part[j], lo[j], hi[j], (a[j], ar[j]), (e[j], er[j])) for j in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["key", "k", "ids"])

    return run


def _giants(big: DataFrame, path: str, chunk: int) -> DataFrame:
    """(key, k, ids) of big(_key, text): the ids of every chunk of the distinct texts.

    Matrices are combined by blocks of chunks, then by texts; the states found so are handed back to the blocks and
    from there to the chunks, so no task needs all chunks of a text.
    """
    cut = stored(mapped(big.select("_key", "text").dropDuplicates(["_key"]), _chunks(path, chunk), "key string, k int, part string, lo int, hi int, final boolean").repartition("key", "k"))
    matrices = stored(mapped(cut, _transfers(path), f"key string, k int, block int, {_MATRIX}"))
    state = "a int, ar int, b int, br int"
    blocks = mapped(matrices.repartition("key", "block").sortWithinPartitions("key", "block", "k"), _combined, f"key string, block int, {_MATRIX}")
    outer = mapped(blocks.repartition("key").sortWithinPartitions("key", "block"), _states("block", False), f"key string, block int, {state}")
    outer = outer.withColumnsRenamed({c: f"{c}0" for c in ("a", "ar", "b", "br")})
    within = matrices.join(outer, ["key", "block"]).repartition("key", "block").sortWithinPartitions("key", "block", "k")
    inner = mapped(within, _states("k", True), f"key string, k int, {state}")
    return mapped(cut.join(inner, ["key", "k"]).select("key", "k", "part", "lo", "hi", "a", "ar", "b", "br"), _traces(path), "key string, k int, ids array<int>")


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs(text, ...) with `ids`, an array of ints (any column of that name goes).

    Null text: empty, which has no ids. Every row stays, repeated ones too; an empty table gives an empty one; other
    columns may have any names. Ties between segmentations of a BPE model can't be: one alone has weight 0; of a
    unigram model's, the one that ends in the larger piece ids wins. Only texts longer than a chunk are shuffled, a
    chunk a row; equal giant texts are encoded once.
    """
    path = path or model_path()
    docs = docs.drop("ids")
    at, key = docs.columns.index("text"), _unused(docs, "key")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            raw = p.encode_all(texts(b.column(at)))
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    giant = F.length(F.coalesce("text", F.lit(""))) > chunk
    small = mapped(docs.where(~giant), whole, added(docs, ids=T.ArrayType(T.IntegerType())))
    big = docs.where(giant).withColumn(key, F.sha2("text", 256))
    ids = _giants(big.select(F.col(key).alias("_key"), "text"), path, chunk)
    joined = ids.groupBy(F.col("key").alias(key)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return small.union(big.join(joined, key).select(*docs.columns, "ids"))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(ids, ...) with `decoded`, the text of the ids (any column of that name goes). Null ids: empty."""
    path = path or model_path()
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            column = b.column(at)
            out = [p.decode(x.values.to_numpy()) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return mapped(encoded, run, added(encoded, decoded=T.StringType()))


_DIGEST = "n_ids long, ids_crc32 long, decoded_sha256 string"
_DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string())


def digest(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_chars, n_ids, ids_crc32, decoded_sha256, round_trip): what encode() and
    decode() give of every text, without carrying ids and texts any further.

    Null text: empty. Every row stays, repeated ones and null ids too. Short texts are encoded, decoded and digested
    by one worker; of giant ones the chunks' ids are decoded in turn, so no worker holds a giant text.
    """
    path = path or model_path()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            rows, many = [], texts(b.column(1))
            for text, raw in zip(many, p.encode_all(many), strict=True):
                decoded = p.decode(np.frombuffer(raw, "<i4"))
                rows.append((len(text), len(raw) // 4, zlib.crc32(raw), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), *_DIGEST_TYPES, pa.bool_()), strict=True))], ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks sorted by (key, k), digested as they come."""
        p, key = pieces_of(path), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, n, crc, sha.hexdigest()), (pa.string(), *_DIGEST_TYPES), strict=True)], ["key", "n_ids", "ids_crc32", "decoded_sha256"])

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if name != key:
                    if key is not None:
                        yield done()
                    key, n, crc, sha = name, 0, 0, hashlib.sha256()
                raw = ids.values.to_numpy().astype("<u4")
                crc = zlib.crc32(raw.tobytes(), crc)
                out = p.surfaces(raw)
                sha.update((out[1:] if not n and p.prefix and out.startswith(b" ") else out).decode("utf-8", "replace").encode())
                n += len(raw)
        if key is not None:
            yield done()

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    giant = F.length(F.coalesce("text", F.lit(""))) > chunk
    small = mapped(docs.where(~giant), whole, f"doc_id long, n_chars long, {_DIGEST}, round_trip boolean")
    big = docs.where(giant).withColumn("key", F.sha2("text", 256))
    ids = _giants(big.select(F.col("key").alias("_key"), "text"), path, chunk).repartition("key").sortWithinPartitions("key", "k")
    found = mapped(ids, chunks, f"key string, {_DIGEST}")
    large = big.select("doc_id", "key", F.length("text").cast("long").alias("n_chars")).join(found, "key")
    return small.union(large.select("doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", (F.col("decoded_sha256") == F.col("key")).alias("round_trip")))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its ids by number and checksum, and what they decode to."""
    return digest(table(spark, sf_dir, "documents"))
