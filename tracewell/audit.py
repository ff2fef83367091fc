"""The whole audit, from files or tables to verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import auditability, balance, gates, integrity, ledger
from tracewell.plans.model import Runs, by_run
from tracewell.sources.files import NOTES, read_runs, without


@dataclass(frozen=True)
class Audit:
    runs: Runs
    bad_runs: DataFrame
    entries: DataFrame
    claims: DataFrame
    balance: DataFrame
    notes: DataFrame


def _read(spark: SparkSession, source: str | Runs, form: str | None, options: dict) -> tuple[Runs, DataFrame, DataFrame]:
    """(runs without those that contradict themselves, bad_runs, notes), each table planned once."""
    if isinstance(source, Runs):
        runs, unread, notes = source.dealt(), spark.createDataFrame([], "run_id string, error string"), spark.createDataFrame([], NOTES)
    else:
        runs, unread, notes = read_runs(spark, source, form, **options)
    bad = by_run(unread.union(integrity.bad_runs(runs)))
    return without(runs, bad).dealt(), bad, notes


def undeclared_tools(notes: DataFrame) -> DataFrame:
    """(run_id, artifact_id) of replies of tools that nothing was declared of; only logs have any."""
    return notes.where("note = 'undeclared'").select("run_id", "artifact_id")


def audit(spark: SparkSession, source: str | Runs, form: str | None = None, require_declared_tools: bool = False, **options) -> Audit:
    """Runs that contradict themselves are named in bad_runs and left out of the rest. With require_declared_tools, a run
    with a reply of a tool that nothing was declared of does not pass."""
    runs, bad, notes = _read(spark, source, form, options)
    entries = by_run(gates.verify(runs))
    claims = ledger.close_books(runs, entries)
    strict = undeclared_tools(notes) if require_declared_tools else None
    return Audit(runs, bad, entries, claims, balance.trial_balance(runs, claims, strict), notes)


def check_trace(spark: SparkSession, source: str | Runs, form: str | None = None, min_reachable: float | None = None, require_declared_tools: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(a verdict for every run, bad_runs)."""
    runs, bad, notes = _read(spark, source, form, options)
    found = auditability.check(runs, notes.where("note = 'truncated'").select("run_id", "artifact_id"), min_reachable)
    if require_declared_tools:
        strict = undeclared_tools(notes).select("run_id").distinct().withColumn("undeclared", F.lit(True))
        found = found.join(strict, "run_id", "left").withColumn("exit_code", F.when(F.col("undeclared"), 1).otherwise(F.col("exit_code"))).drop("undeclared")
    return found, bad
