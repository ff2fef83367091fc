"""What the settled claims of a run come to: histogram, coverage, letters of the answer, and the exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.udfs import letters
from tracewell.operators.spans import merged
from tracewell.plans.model import CLOSING, FAILING, STATUSES, Runs, piece


def closes(status: Column) -> Column:
    return status.isin(*CLOSING)


def final_claims(runs: Runs, audits: DataFrame) -> DataFrame:
    """Audits of the claims that stand in a final answer."""
    finals = runs.artifacts.where("kind = 'final_answer'").select("run_id", "artifact_id")
    return audits.join(finals, ["run_id", "artifact_id"], "left_semi")


def status_counts(audits: DataFrame) -> DataFrame:
    """(run_id, one column a status): the histogram, zeros included. Of final_claims() it is the headline; audits hold
    every intermediate claim too."""
    return audits.groupBy("run_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def injection_points(runs: Runs, audits: DataFrame) -> DataFrame:
    """Where the chain of each failing claim of a final answer breaks."""
    return final_claims(runs, audits).where(F.col("status").isin(*FAILING)).select("run_id", "claim_id", "status", "break_claim_id", "break_step_id", "break_reason")


def _letters_under(runs: Runs, spans: DataFrame, name: str) -> DataFrame:
    texts = runs.artifacts.where("kind = 'final_answer'").select("run_id", "artifact_id", "content")
    parts = merged(spans.select("run_id", "artifact_id", "start", "end"), ["run_id", "artifact_id"]).join(texts, ["run_id", "artifact_id"])
    return parts.groupBy("run_id").agg(F.sum(letters(piece(F.col("content"), F.col("start"), F.col("end")))).alias(name))


def answer_cover(runs: Runs, audits: DataFrame) -> DataFrame:
    """(run_id, total, claimed, closed): letters and digits of the final answers, those under a claim, and those under
    one that closes; what several claims cover counts once."""
    finals = runs.artifacts.where("kind = 'final_answer'")
    total = finals.select("run_id", letters("content").alias("n")).groupBy("run_id").agg(F.sum("n").alias("total"))
    spans = runs.claims.join(finals.select("run_id", "artifact_id"), ["run_id", "artifact_id"], "left_semi")
    closed = spans.join(audits.where(closes(F.col("status"))).select("run_id", "claim_id"), ["run_id", "claim_id"], "left_semi")
    x = runs.run_ids().join(total, "run_id", "left")
    for part, name in ((spans, "claimed"), (closed, "closed")):
        x = x.join(_letters_under(runs, part, name), "run_id", "left")
    return x.na.fill(0, ["total", "claimed", "closed"]).withColumn("mostly_unclaimed", 2 * (F.col("total") - F.col("claimed")) > F.col("total"))


def trial_balance(runs: Runs, audits: DataFrame, undeclared_tools: DataFrame | None = None) -> DataFrame:
    """A row for every run: final claims, how many close, coverage, laundering rate, cover of the answer, whether the
    books balance (not if there is no final claim), the reasons that they do not, and the exit code: 0 closes, 1 fails,
    2 could not be checked."""
    f = final_claims(runs, audits)
    per = f.groupBy("run_id").agg(
        F.count("*").alias("final_claims"),
        F.count_if(closes(F.col("status"))).alias("closing"),
        F.count_if(F.col("status") == "laundered").alias("laundered"),
        F.count_if(F.col("status") == "unchecked").alias("unchecked"),
        F.sort_array(F.collect_list("claim_id")).alias("final_claim_ids"),
    )
    answers = runs.artifacts.where("kind = 'final_answer'").groupBy("run_id").agg(F.count("*").alias("answers"))
    any_claim = runs.claims.groupBy("run_id").agg(F.count("*").alias("claims"))
    x = answer_cover(runs, audits).join(per, "run_id", "left").join(answers, "run_id", "left").join(any_claim, "run_id", "left")
    if undeclared_tools is not None:
        x = x.join(undeclared_tools.select("run_id").distinct().withColumn("undeclared", F.lit(True)), "run_id", "left")
    else:
        x = x.withColumn("undeclared", F.lit(False))
    x = x.na.fill(0, ["final_claims", "closing", "laundered", "unchecked", "answers", "claims"]).na.fill(False, ["undeclared"])
    n = F.col("final_claims")
    balance = (n > 0) & (F.col("closing") == n)
    x = x.withColumns({"coverage": F.when(n > 0, F.col("closing") / n).otherwise(0.0), "laundering_rate": F.when(n > 0, F.col("laundered") / n).otherwise(0.0), "books_balance": balance})
    failed = n - F.col("closing") - F.col("unchecked")
    flags = (
        (failed > 0, "books_do_not_balance"),
        (F.col("answers") > 1, "multiple_final_answers"),
        ((n > 0) & F.col("mostly_unclaimed"), "answer_mostly_unclaimed"),
        (F.col("undeclared"), "undeclared_tools"),
        (F.col("unchecked") > 0, "chain_too_deep"),
    )
    x = x.withColumn("reasons", F.array_compact(F.array(*(F.when(c, name) for c, name in flags))))
    only_deep = F.size(F.array_except("reasons", F.array(F.lit("chain_too_deep")))) == 0
    return x.withColumn("exit_code", F.when((F.col("claims") == 0) | (n == 0), 2).when(F.size("reasons") == 0, 0).when(only_deep, 2).otherwise(1)).drop("undeclared")
