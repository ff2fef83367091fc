"""What makes a run unreadable: rows that contradict each other. Errors are rows, never exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.udfs import normal_form
from tracewell.plans.model import Runs, piece, step_outputs


def _error(df: DataFrame, message: Column) -> DataFrame:
    return df.select("run_id", message.alias("error"))


def _twice(df: DataFrame, key: str, what: str) -> DataFrame:
    again = df.groupBy("run_id", key).agg(F.count("*").alias("n")).where("n > 1")
    return _error(again, F.concat(F.lit(f"{what} "), F.col(key), F.lit(" is given twice")))


def bad_runs(runs: Runs) -> DataFrame:
    """(run_id, error): every contradiction of every run, by anti joins and counts."""
    a, s, c, e = runs.artifacts, runs.steps, runs.claims, runs.entries
    ids = a.select("run_id", "artifact_id")
    used = s.select("run_id", "step_id", F.explode(F.concat("inputs", "outputs")).alias("artifact_id"))
    made = step_outputs(s).groupBy("run_id", "artifact_id").agg(F.countDistinct("step_id").alias("n")).where("n > 1")
    placed = c.join(a.select("run_id", "artifact_id", "content"), ["run_id", "artifact_id"])
    outside = placed.where(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("content"))))
    inside = placed.where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("content")))
    inside = inside.withColumn("there", piece(F.col("content"), F.col("start"), F.col("end"))).where(F.col("there") != F.col("text"))
    other = inside.where(normal_form(F.col("there")) != normal_form(F.col("text")))
    shared = e.where("grp <> ''").groupBy("run_id", "grp").agg(F.countDistinct("claim_id").alias("n")).where("n > 1")
    found = [
        _twice(a, "artifact_id", "artifact"),
        _twice(s, "step_id", "step"),
        _twice(c, "claim_id", "claim"),
        _twice(e, "entry_id", "entry"),
        _error(used.join(ids, ["run_id", "artifact_id"], "left_anti"), F.concat(F.lit("step "), F.col("step_id"), F.lit(" names the unknown artifact "), F.col("artifact_id"))),
        _error(made, F.concat(F.lit("artifact "), F.col("artifact_id"), F.lit(" is made by more than one step"))),
        _error(c.join(ids, ["run_id", "artifact_id"], "left_anti"), F.concat(F.lit("claim "), F.col("claim_id"), F.lit(" stands in an unknown artifact"))),
        _error(outside, F.concat(F.lit("claim "), F.col("claim_id"), F.lit(" lies outside its artifact"))),
        _error(other, F.concat(F.lit("claim "), F.col("claim_id"), F.lit(" is not what stands at its span"))),
        _error(e.join(c.select("run_id", "claim_id"), ["run_id", "claim_id"], "left_anti"), F.concat(F.lit("entry "), F.col("entry_id"), F.lit(" is for an unknown claim"))),
        _error(shared, F.concat(F.lit("group "), F.col("grp"), F.lit(" holds entries of several claims"))),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
