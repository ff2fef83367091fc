"""Document fingerprints by I-Match, in DataFrame functions only.

Terms within a band of inverse document frequency are kept; the sorted distinct ones are hashed whole, and again for
several randomised subsets of the lexicon. Two fingerprints are as alike as the share of subsets that hash the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewell.llm.common import cut_lineage, table

#: The band: terms that at least LOW and at most HIGH of all documents hold (idf from ln 5 to ln 100). The lexicon
#: has at most (mean number of distinct terms of a document) / LOW terms, however many documents there are.
LOW, HIGH = 0.01, 0.2
#: Randomised lexicon subsets, each with one term in RATE (a power of two).
SUBSETS, RATE = 32, 32
#: Rows that share a range of ids when each document is given the next one, and how many ranges there are at most.
RANGE_ROWS, RANGES = 64, 65_536
#: Quantiles of the ids that ranges are laid between.
QUANTILES = 128

SCHEMA = "struct<full:bigint,subs:array<bigint>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


@dataclass(frozen=True)
class Lexicon:
    """The terms of the band, and those of each randomised subset."""

    terms: tuple[int, ...]
    subsets: tuple[tuple[int, ...], ...]


def _chosen(term: Column, subset: Column) -> Column:
    return F.xxhash64(term, subset).bitwiseAND(F.lit(RATE - 1)) == 0


def _seeds() -> Column:
    return F.sequence(F.lit(0), F.lit(SUBSETS - 1))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> Lexicon:
    """The terms of docs(text) within the band, at most (mean number of distinct terms) / low of them."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce("text", F.lit(""))))).groupBy("col").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= low * n) & (F.col("df") <= high * n))
    rows = sorted(band.select("col", F.filter(_seeds(), lambda j: _chosen(F.col("col"), j)).alias("chosen")).collect())
    return Lexicon(tuple(r[0] for r in rows), tuple(tuple(r[0] for r in rows if j in r[1]) for j in range(SUBSETS)))


def _among(array: str, known: tuple[int, ...]) -> str:
    """SQL for the members of an array that are known: a static set, looked up once a member."""
    return f"filter({array}, h -> h IN ({', '.join(f'{x}L' if x > -(1 << 63) else f'({x + 1}L - 1L)' for x in known)}))" if known else f"filter({array}, h -> false)"


def fingerprinted(docs: DataFrame, text: str, into: str, lex: Lexicon) -> DataFrame:
    """docs with a column of SCHEMA. A text without a term in the band is taken by all its terms, one without terms by
    itself; these choose their subsets by hash, as the lexicon's were chosen."""
    hashed = lambda s: F.when(F.size(s) > 0, F.xxhash64(s))
    of_band = F.array(*(let(F.expr(_among("_kept", known)), hashed) for known in lex.subsets))
    of_others = F.transform(_seeds(), lambda j: let(F.filter("_kept", lambda h: _chosen(h, j)), hashed))
    x = docs.withColumn("_terms", terms(F.col(text))).withColumn("_band", F.array_sort(F.expr(_among("_terms", lex.terms))))
    kept = F.when(F.size("_band") > 0, F.col("_band")).when(F.size("_terms") > 0, F.array_sort("_terms")).otherwise(F.array(F.xxhash64(text)))
    x = x.withColumn("_kept", kept)
    return x.withColumn(into, F.struct(F.xxhash64("_kept").alias("full"), F.when(F.size("_band") > 0, of_band).otherwise(of_others).alias("subs"))).drop("_terms", "_band", "_kept")


def written(fp: Column) -> Column:
    """The fingerprint as text: 16 hex digits of the whole, then 8 of each subset ("-" for one without terms)."""
    return F.concat(F.lpad(F.lower(F.hex(fp["full"])), 16, "0"), F.lit(":"), F.array_join(F.transform(fp["subs"], lambda s: F.when(s.isNull(), "-").otherwise(F.right(F.lpad(F.lower(F.hex(s)), 16, "0"), F.lit(8)))), "."))


def likeness(a: Column, b: Column) -> Column:
    """1 if all terms are the same, else the share of equal ones among the subsets that either holds."""
    same = F.zip_with(a["subs"], b["subs"], lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce((x == y).cast("int"), F.lit(0))))
    share = let(F.array_compact(same), lambda s: F.when(F.size(s) > 0, F.size(F.filter(s, lambda v: v == 1)) / F.size(s)).otherwise(F.lit(0.0)))
    return F.when(a["full"] == b["full"], F.lit(1.0)).otherwise(share)


def _range(docs: DataFrame) -> Column:
    """A number that falls with a row's place by descending doc_id, equal for rows of a bounded stretch of ids.

    Quantiles of the ids are cut further into equal widths, so an id far from all others moves no other row's range.
    Rows without an id are spread by the hash of their text. Ids are compared as doubles: no difference overflows.
    """
    at = F.col("doc_id").cast("double")
    n = min(RANGES, max(1, docs.count() // RANGE_ROWS))
    q = min(QUANTILES, n)
    cuts = sorted(set(docs.select(at.alias("at")).approxQuantile("at", [k / q for k in range(q + 1)], 0.2 / q)))
    parts = -(-n // q)

    def place(lo: int, hi: int) -> Column:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(at < cuts[mid], place(lo, mid)).otherwise(place(mid, hi))
        width = (cuts[hi] - cuts[lo]) / parts if hi < len(cuts) else 0.0
        within = F.floor((at - cuts[lo]) / F.lit(width or 1.0))
        return F.lit(lo * parts) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), within))

    known = place(0, max(1, len(cuts) - 1)) if cuts else F.lit(0)
    return F.when(F.col("doc_id").isNull(), -1 - F.shiftright(F.col("hash"), 56) - 128).otherwise(known).cast("long")


def with_next(docs: DataFrame, columns: list[str], derived: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """derived(docs) with next_<column>: the values of the next document by descending doc_id; after the last, the first.

    A null doc_id comes last; equal ones are ordered by a hash of their text. Ids are cut into ranges, each range is a
    window of its own, and the first row of the range below is put to it as one more row, so no task sees all documents.
    """
    docs = docs.withColumn("hash", F.xxhash64("text"))
    docs = docs.withColumn("range", _range(docs)).withColumn("ghost", F.lit(0))
    first = F.max_by(F.struct("doc_id", "hash"), F.struct(F.col("doc_id"), F.bitwise_not("hash")))
    heads = docs.groupBy("range").agg(first.alias("head"))  # at most RANGES and 256 rows
    order = W.orderBy("range")
    heads = cut_lineage(heads.select("head", F.coalesce(F.lead("range").over(order), F.min("range").over(W.orderBy(F.lit(1)))).alias("above")))
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("hash") == F.col("head.hash"))
    ghosts = docs.join(F.broadcast(heads), same).select(*docs.columns[:-2], F.col("above").alias("range"), F.lit(1).alias("ghost"))
    down = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "hash")
    return derived(docs.union(ghosts)).withColumns({f"next_{c}": F.lead(c).over(down) for c in columns}).where("ghost = 0").drop("range", "ghost", "hash")


def compare(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): each document's fingerprint, that of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. Null text: empty. Equal texts have equal fingerprints. Repeated rows stay, one the next of the other;
    texts of any length are read whole. A single document is its own next one; no documents give no rows. Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(docs)
    d = with_next(docs, ["text", "fp"], lambda x: fingerprinted(x, "text", "fp", lex))
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    d = fingerprinted(d, "edited", "efp", lex)
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("fp")).alias("fingerprint"), written(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
