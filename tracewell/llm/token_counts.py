"""Token counts by a trie of pre-tokens: the forward pass over pieces is made once for every shared prefix.

A node of the trie is a prefix of some pre-token and holds the forward result there: the best weight of a segmentation
of the prefix, its last piece and its number of pieces. A new pre-token costs one step for every character beyond the
longest prefix that is in the trie already; its count is stored at its end and read from there ever after.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Memo, added, mapped, table, texts
from tracewell.llm.sentence_pieces import START, Pieces, model_path, pieces_of, segments

#: Nodes of a worker's trie; it starts anew beyond them, so its memory is bounded.
NODES = 300_000
#: Characters of the longest pre-token whose path is kept for the next one.
PATH = 4096
_FAR = float("-inf")
Score = tuple[float, int, int]  # the best weight of a prefix, its last piece, its number of pieces


class Trie:
    """The trie of pre-tokens with their forward scores, and the counts at terminals."""

    def __init__(self, pieces: Pieces, nodes: int = NODES):
        self.pieces, self.most = pieces, nodes
        self.terminal = Memo(self.insert, self.insert_sorted)
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.scores: list[Score] = [(0.0, START, 0)]

    def _step(self, word: str, e: int, before: deque[Score] | list[Score]) -> Score:
        """The forward score of word[:e] from those of its prefixes, the last of them in `before`."""
        p = self.pieces
        ids, pairs, found = p.ids, p.pairs, (_FAR, START, 0)
        for k in range(1, min(len(before), p.longest) + 1):
            best, last, count = before[-k]
            if best == _FAR:
                continue
            i = ids.get(word[e - k : e])
            if i is None:
                if k > 1:
                    continue
                i = -2 - ord(word[e - 1])
            known = pairs.get((last, i)) if p.bpe else None
            w = (0.0 if known else _FAR) if known is not None else best + p.weight(last, i)
            if w > found[0]:
                found = (w, i, count + (1 if i >= 0 else max(1, len(chr(-2 - i).encode("utf-8", "replace")) if p.bytes else 1)))
                if p.bpe:
                    break
        return found

    def insert(self, word: str) -> int:
        """Puts a pre-token into the trie and gives its number of pieces.

        The forward pass needs the last few scores only, so where the trie is full in the middle of a pre-token (which
        may be of any length) it goes on without new nodes.
        """
        if len(self.children) > self.most:
            self._clear()
        node: int | None = 0
        before = deque([self.scores[0]], maxlen=self.pieces.longest)
        for e, c in enumerate(word, 1):
            below = self.children[node] if node is not None else None
            following = below.get(c) if below is not None else None
            if following is None:
                score = self._step(word, e, before)
                if node is not None and len(self.children) <= 2 * self.most:
                    if below is None:
                        below = self.children[node] = {}
                    following = below[c] = len(self.children)
                    self.children.append(None)
                    self.scores.append(score)
            else:
                score = self.scores[following]
            node = following
            before.append(score)
        return before[-1][2]

    def insert_sorted(self, words: list[str]) -> Iterator[int]:
        """insert() of sorted pre-tokens: each goes on in the trie from where it parts from the one before it."""
        nodes, scores, before = [0], [self.scores[0]], ""
        for word in words:
            if len(word) > PATH:
                yield self.insert(word)
                nodes, scores, before = [0], [self.scores[0]], ""
                continue
            if len(self.children) > self.most:
                self._clear()
                nodes, scores, before = [0], [self.scores[0]], ""
            k = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                k += 1
            del nodes[k + 1 :], scores[k + 1 :]
            children, known = self.children, self.scores
            for e in range(k + 1, len(word) + 1):
                node, c = nodes[-1], word[e - 1]
                below = children[node]
                following = below.get(c) if below is not None else None
                if following is None:
                    score = self._step(word, e, scores)
                    if below is None:
                        below = children[node] = {}
                    following = below[c] = len(children)
                    children.append(None)
                    known.append(score)
                nodes.append(following)
                scores.append(known[following])
            before = word
            yield scores[-1][2]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """tokens() of many texts; the pre-tokens that are new in them enter the trie together."""
        parts = [self.pieces.cut(s) if self.pieces.by_words else [s] if s else [] for s in map(self.pieces.normal, texts)]
        self.terminal.learn({w for part in parts for w in part})
        return [(sum(map(self.terminal.__getitem__, part)), len(part)) for part in parts]

    def tokens(self, text: str) -> tuple[int, int]:
        """The number of pieces and of pre-tokens of a whole text."""
        return self.count([text])[0]


_tries: dict[str, Trie] = {}


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(text, ...) with `n_tokens` and `n_pretokens` (columns of those names go).

    Null text: empty, which has none. Every row stays, repeated ones too; an empty table gives an empty one; other
    columns may have any names. Texts and pre-tokens of any length are counted whole. Nothing is shuffled: each task
    builds the trie of its own distinct pre-tokens.
    """
    path = path or model_path()
    docs = docs.drop("n_tokens", "n_pretokens")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _tries.get(path) or _tries.setdefault(path, Trie(pieces_of(path)))
        for b in batches:
            both = trie.count(texts(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in both], pa.int64()) for k in (0, 1))], [*b.schema.names, "n_tokens", "n_pretokens"])

    return mapped(docs, run, added(docs, n_tokens=T.LongType(), n_pretokens=T.LongType()))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return count(docs).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_pretokens", "n_tokens")
