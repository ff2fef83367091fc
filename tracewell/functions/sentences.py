"""Sentences of a text by their spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.functions.batches import mapped
from tracewell.functions.locate import has_words

#: Words whose full stop ends no sentence; initialisms ("U.S.", "e.g.") are read by their shape.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "Inc", "Ltd", "Co", "Corp", "No", "Fig", "vs", "approx")
#: A sentence has so many characters and words at least; lines that open a heading or a table row have none.
LEAST_CHARS, LEAST_WORDS, NOT_OPENING = 15, 2, "#|"

_ABBREVIATED = re.compile(rf"(?:\A|.*\s)(?:{'|'.join(ABBREVIATIONS)}|(?:[A-Za-z]\.)+[A-Za-z])", re.S)
_END = re.compile(r"[.!?]+(?=\s|$)")


def _ends(line: str) -> list[int]:
    """Where the sentences of a line end: at stops, but for a lone full stop behind an abbreviation, and at its end."""
    out = []
    for m in _END.finditer(line):
        word = line[max(0, m.start() - 64) : m.start()].rsplit(None, 1)[-1:] if m[0] == "." else []
        if not (word and _ABBREVIATED.fullmatch(word[0])):
            out.append(m.end())
    return out if out and out[-1] == len(line) else [*out, len(line)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of every line that are long enough."""
    out: list[tuple[int, int]] = []
    base = 0
    for line in text.split("\n"):
        start = 0
        for stop in _ends(line) if line.lstrip()[:1] not in (*NOT_OPENING, "") else ():
            part = line[start:stop]
            lead = len(part) - len(part.lstrip())
            if len(part) - lead >= LEAST_CHARS and has_words(part, LEAST_WORDS):
                out.append((base + start + lead, base + stop))
            start = stop
        base += len(line) + 1
    return out


#: Sentences and their characters that a batch gives out at most, the last sentence beyond.
OUT_ROWS, OUT_CHARS = 10_000, 2_000_000


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string())])
    for b in batches:
        out, chars = [], 0
        for k in range(b.num_rows):
            doc, text = b.column(0)[k].as_py(), b.column(1)[k].as_py() or ""
            for nth, (start, end) in enumerate(sentences(text)):
                out.append((doc, nth, start, end, text[start:end]))
                chars += end - start
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield _table(out, schema)
                    out, chars = [], 0
        if out:
            yield _table(out, schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, start, end, sentence): the sentences of docs(doc_id, text), given out as they are found."""
    return mapped(docs.select("doc_id", "text"), _split, "doc_id long, nth int, start int, end int, sentence string")
