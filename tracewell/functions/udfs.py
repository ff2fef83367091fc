"""The text rules as Arrow-batched functions. Each is total: null in, null out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import quotes
from tracewell.functions.batches import bound
from tracewell.functions.textview import normal


def _batched(kind: T.DataType) -> Callable:
    """A pandas function over batches that are bounded in rows and bytes."""

    def made(f: Callable) -> Callable[..., Column]:
        over = F.pandas_udf(f, kind)

        def call(*columns: Column | str) -> Column:
            bound(SparkSession.active())
            return over(*columns)

        return call

    return made


@_batched(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(normal, na_action="ignore")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normal_form(text: Column | str) -> Column:
    """textview.normal(); texts of ASCII alone, where that is spaces and case, don't go through Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\t-\r\x1c-\x20]{2,}|[\t-\r\x1c-\x1f]", " ")))
    return F.coalesce(F.when(is_ascii(text), plain), _folded(F.when(~is_ascii(text), text)))


def _gate(text: str, start: int, end: int, quote: str) -> str:
    if start < end:
        around = quotes.Around(text, start, end)
        if around.cuts_a_number():
            return "span_cuts_a_number"
        if around.cuts_a_word():
            return "span_cuts_a_word"
    return "ok" if quotes.says_the_same(normal(text[start:end]), normal(quote)) else "span_mismatch"


@_batched(T.StringType())
def quote_gate(text: pd.Series, start: pd.Series, end: pd.Series, quote: pd.Series) -> pd.Series:
    """Whether [start, end) of a text is cut well and says what the quote says: a reason, or "ok"."""
    return pd.Series([None if t is None else _gate(t, int(a), int(b), q) for t, a, b, q in zip(text, start, end, quote, strict=True)], dtype=object)


@_batched(T.LongType())
def letters(text: pd.Series) -> pd.Series:
    """How many letters and digits a text has."""
    return text.map(lambda t: sum(map(str.isalnum, t)) if t else 0).astype("int64")
