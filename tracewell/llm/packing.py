"""Best-fit packing of token sequences: a configuration linear program over the histogram of lengths.

The histogram has at most `capacity` distinct lengths whatever the corpus holds, so the plan is made on the driver
from a table of bounded size; documents never leave the executors. The program (fewest sequences so that every
length is covered) is solved by multiplicative weights: each round prices configurations by a knapsack dynamic
programme under the present weights, uses the best one in whole sequences and lowers the weights of the lengths it
covers, until every length is covered.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewell.llm.common import cut_lineage, mapped, table, texts

CAPACITY = 4096
#: The id that ends a document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Characters of words whose ids a Python worker keeps; each word costs 64 of them besides its own.
MEMO_CHARS = 24_000_000
#: Salts that spread the ranking of equal lengths over tasks.
SALTS = 1024
#: Lengths that a round of the covering program prices first, and how near to the best a configuration must come: of
#: one that was priced among some lengths, and of one that was priced among all.
SOME, NEAR, NEAR_ALL = 256, 2e-4, 5e-4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters that Python's split() takes for white space and the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordIds:
    """Ids of texts by a tokenizer that never joins across white space; ids of words already seen are kept.

    Misses go to the tokenizer: words of letters, with or without marks behind them, to its model as pre-tokens;
    others to the whole of it, one by one.
    """

    def __init__(self, path: str, keep: int = MEMO_CHARS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.keep, self.memo, self.held = Tokenizer.from_file(path), keep, {}, 0
        self.letters = byte_letters()

    def _direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a lower-case word of letters: one pre-token, so the model is asked without what precedes it."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return np.array([t.id for t in self.tok.model.tokenize(word)], "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        memo = self.memo
        for w in words:
            core = w.rstrip(".,!?*%&$#|;:")
            low = core.lower()
            if not (low.isalpha() and core.isalpha() and (low.isascii() or len(low) == len(core) and "\u03a3" not in core and unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", low))):
                memo[w] = self._direct(w)
                continue
            ids = memo.get(low)
            if ids is None:
                ids = memo[low] = self._word(low)
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in memo:
                    memo[tail] = self._direct(tail)
                memo[w] = ids + memo[tail]
            elif w != low:
                memo[w] = ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in _SEPARATORS):
            return self._direct(text)
        words = text.split()
        found = list(map(self.memo.get, words))
        if None in found:
            missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
            if self.held > self.keep:
                self.memo.clear()
                self.held, missing = 0, set(words)
            self.held += sum(len(w) + 64 for w in missing)
            self._learn(missing)
            found = map(self.memo.__getitem__, words)
        return b"".join(found)


_word_ids: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of docs(doc_id, text): the ids and END_ID, cut only where they exceed capacity. Null text: empty."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _word_ids.get(path) or _word_ids.setdefault(path, WordIds(path))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                raw = enc.ids(text) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def priced(lengths: np.ndarray, values: np.ndarray, capacity: int, most: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
    """The knapsack dynamic programme: the largest total value of a multiset of lengths within every capacity up to
    the given one, and the steps that configuration() reads them back from.

    `most`: how often each length may be taken at most. Copies are taken by powers of two, longest lengths first.
    """
    best, steps = np.zeros(capacity + 1), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, value, copies = int(lengths[i]), float(values[i]), 1
        left = capacity // length if most is None else min(int(most[i]), capacity // length)
        while left > 0:
            copies = min(copies, left)
            with_it = best[: capacity + 1 - length * copies] + value * copies
            without = best[length * copies :]
            better = with_it > without
            np.maximum(with_it, without, out=without)
            steps.append((length, copies, better))
            left -= copies
            copies *= 2
    return best, steps


def configuration(steps: list[tuple], capacity: int) -> Counter:
    """The multiset of lengths that is worth most within this capacity."""
    found: Counter = Counter()
    for length, copies, better in reversed(steps):
        if capacity >= length * copies and better[capacity - length * copies]:
            found[length] += copies
            capacity -= length * copies
    return found


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int, most: np.ndarray | None = None) -> Counter:
    return configuration(priced(lengths, values, capacity, most)[1], capacity)


def covering(counts: dict[int, int], capacity: int, rounds: int | None = None, rate: float = 0.02) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used: the covering program by multiplicative weights, in whole steps.

    A length's weight is its share of the capacity times exp(-rate * the share of it that is covered already), so that
    full configurations of lengths that are least covered are priced highest. A round prices SOME lengths first: those
    of the greatest weight for their size and others spread over the rest. What they give is taken if it comes within
    NEAR of a bound on what all lengths could give (the capacity at the greatest weight for its size, and what all
    gave when they were last priced together: weights and counts only fall); else more are priced, all of them at
    last. One programme holds the best configuration of every capacity, and all that are within NEAR of the best are
    used. Configurations hold no length more often than it is still left, and each is used as often as they are left
    for, so rounds depend on the capacity, not on the counts, and nothing is left to round.
    """
    lengths = np.array(sorted(counts, reverse=True), int)
    n = np.array([counts[x] for x in lengths.tolist()], int)
    at, rest, out = {x: i for i, x in enumerate(lengths.tolist())}, n.copy(), []
    for i in np.flatnonzero(lengths + lengths.min(initial=capacity) > capacity).tolist():  # fits with nothing: alone
        out.append(({int(lengths[i]): 1}, int(n[i])))
        rest[i] = 0
    top, done = np.inf, 0
    while rest.any() and (rounds is None or done < rounds):
        left = np.flatnonzero(rest)
        weight = np.exp(-rate * (1 - rest[left] / n[left])) / capacity
        bound, size = min(top, capacity * weight.max()), SOME
        by_weight = np.argsort(-weight, kind="stable")
        while True:
            own = np.arange(len(left))
            if size < len(left):
                half = size // 2
                spread = np.linspace(0, len(left) - half - 1, size - half).astype(int)
                own = np.unique(np.concatenate([by_weight[:half], by_weight[half:][spread]]))
            some = left[own]
            best, steps = priced(lengths[some], lengths[some] * weight[own], capacity, rest[some])
            whole = len(own) == len(left)
            if whole or best[capacity] >= (1 - NEAR) * bound:
                break
            size *= 8
        top = best[capacity] if whole else top
        for c in range(capacity, 0, -1):
            if best[c] < (1 - (NEAR_ALL if whole else NEAR)) * best[capacity]:
                break
            pattern = configuration(steps, c)
            times = min((int(rest[at[k]]) // v for k, v in pattern.items()), default=0)
            if times:
                for k, v in pattern.items():
                    rest[at[k]] -= times * v
                out.append((dict(pattern), times))
        done += 1
    return out


def best_fit(rest: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on a histogram: every sequence takes the longest lengths that still fit it.

    Sequences that come out alike are made together, so the work depends on the number of distinct lengths.
    """
    lengths = np.array(sorted(rest))
    n = np.array([rest[x] for x in lengths])
    out: list[tuple[tuple[int, ...], int]] = []
    hi = len(lengths) - 1
    while hi >= 0:
        if not n[hi]:
            hi -= 1
            continue
        room, taken = capacity, []
        used: Counter = Counter()
        j = hi
        while room > 0 and j >= 0:
            j = min(j, int(np.searchsorted(lengths, room, side="right")) - 1)
            while j >= 0 and n[j] - used[j] <= 0:
                j -= 1
            if j < 0:
                break
            taken.append(int(lengths[j]))
            used[j] += 1
            room -= int(lengths[j])
        times = min(int(n[j]) // c for j, c in used.items())
        for j, c in used.items():
            n[j] -= times * c
        out.append((tuple(taken), times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): a packing of the whole histogram.

    What a limit on the rounds leaves over is placed best fit; if best fit alone takes fewer sequences, it is the plan.
    """
    rest = Counter({k: v for k, v in counts.items() if k < capacity})
    out: list[tuple[tuple[int, ...], int]] = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    if rest:
        alone, made = best_fit(rest, capacity), []
        for pattern, times in covering(dict(rest), capacity, rounds):
            made.append((tuple(sorted((k for k, v in pattern.items() for _ in range(v)), reverse=True)), times))
            for k, v in pattern.items():
                rest[k] -= times * v
        made += best_fit(+rest, capacity) if +rest else []
        out += min(made, alone, key=lambda p: sum(times for _, times in p))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """docs(doc_id, text) as pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of END_ID alone; equal rows are packed each for itself; other columns are
    ignored. An empty table gives an empty result. Among pieces of equal length any may take any place. Pieces of one
    length are numbered by salts (so that a length that a third of all pieces have is spread over tasks), and the
    numbers are looked up in the plan, whose size depends on the capacity only.
    """
    spark = docs.sparkSession
    found = cut_lineage(pieces(docs, path, capacity))
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple]] = defaultdict(list)  # by length: (first rank, end rank, first sequence, copies, offset)
    ranks, sequence = Counter(), 0
    for lengths, times in plan(counts, capacity, rounds):
        copies, offset = Counter(lengths), 0
        for length in dict.fromkeys(lengths):
            k = copies[length]
            slots[length].append((length, ranks[length], ranks[length] + times * k, sequence, k, offset))
            ranks[length] += times * k
            offset += k * length
        sequence += times
    rows = [r for length in slots for r in slots[length]]
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, first long, copies long, base long")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    many = found.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = many.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.alias("p").join(F.broadcast(places).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.lo")) & (F.col("p.rank") < F.col("s.hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("first") + F.floor(nth / F.col("copies"))).alias("sequence_id"), (F.col("base") + F.pmod(nth, F.col("copies")) * F.col("p.length")).alias("offset"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
