"""Joins and measures of spans of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewell.plans.model import is_blank


def overlapping(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of left(start, end) and right(r_start, r_end) with equal `by` whose half-open spans overlap."""
    return left.join(right, by).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))


def covering(spans: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """spans(run_id, key, artifact_id, start, end, content) with the claims that overlap them.

    members: claim ids by (start, claim_id), empty if none; whole: whether every character of the span that is not
    white space lies in one of them.
    """
    right = claims.select("run_id", "artifact_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "claim_id")
    got = overlapping(spans.drop("content"), right, ["run_id", "artifact_id"]).groupBy("run_id", key).agg(F.sort_array(F.collect_list(F.struct("r_start", "claim_id", "r_end"))).alias("under"))
    x = spans.join(got, ["run_id", key], "left").withColumn("under", F.coalesce("under", F.array().cast("array<struct<r_start:int,claim_id:string,r_end:int>>")))
    begin = F.struct(F.col("start").alias("reach"), F.lit("").alias("gaps"))

    def walk(acc, c):
        gap = F.substring(F.col("content"), acc["reach"] + 1, F.greatest(F.lit(0), c["r_start"] - acc["reach"]))
        return F.struct(F.greatest(acc["reach"], c["r_end"]).alias("reach"), F.concat(acc["gaps"], gap).alias("gaps"))

    walked = F.aggregate("under", begin, walk)
    rest = F.concat(walked["gaps"], F.substring(F.col("content"), walked["reach"] + 1, F.greatest(F.lit(0), F.col("end") - walked["reach"])))
    return x.select("run_id", key, F.transform("under", lambda c: c["claim_id"]).alias("members"), ((F.size("under") > 0) & is_blank(rest)).alias("whole"))


def merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """The union of spans(by, start, end) as disjoint, maximal ones; touching spans are one."""
    earlier = W.partitionBy(*by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    islands = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(earlier), F.lit(-1))).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(W.partitionBy(*by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
