"""The gates: whether each journal entry funds its claim, and if not, the first gate that it fails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.signs import RUN, RUNS
from tracewell.functions.udfs import quote_gate
from tracewell.operators.graph import components
from tracewell.plans.model import OK, REASONS, Runs, account, by_run, is_blank, is_root, step_inputs, step_outputs

#: Characters of the source on either side of a span that the boundary rules can see.
AROUND = RUNS * RUN


def step_edges(runs: Runs) -> DataFrame:
    """Data flow: (run_id, a, b) where step b takes in what step a made."""
    made = step_outputs(runs.steps).select("run_id", "artifact_id", F.col("step_id").alias("a"))
    taken = step_inputs(runs.steps).select("run_id", "artifact_id", F.col("step_id").alias("b"))
    return made.join(taken, ["run_id", "artifact_id"]).select("run_id", "a", "b").distinct()


def step_loops(runs: Runs) -> DataFrame:
    """(run_id, step_id, loop) of the steps that stand in a loop with others; one grouped map over each run's edges."""

    def loops(edges: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, set[str]] = {}
        for a, b in zip(edges["a"], edges["b"], strict=True):
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
        found = [(m, min(c)) for c in components(out, out) if len(c) > 1 for m in c]
        return pd.DataFrame({"run_id": edges["run_id"].iloc[0], "step_id": [m for m, _ in found], "loop": [c for _, c in found]}, dtype=object)

    # a loop needs a step that is fed by one of its own followers: runs whose edges all go forward have none
    order = runs.steps.select("run_id", "step_id", "ord")
    edges = step_edges(runs).where("a <> b")
    back = edges.join(order.select("run_id", F.col("step_id").alias("a"), F.col("ord").alias("oa")), ["run_id", "a"]).join(order.select("run_id", F.col("step_id").alias("b"), F.col("ord").alias("ob")), ["run_id", "b"]).where("oa >= ob")
    suspect = edges.join(back.select("run_id").distinct(), "run_id", "left_semi")
    return suspect.groupBy("run_id").applyInPandas(loops, "run_id string, step_id string, loop string")


def verify(runs: Runs) -> DataFrame:
    """runs.entries with the account taken apart and `claim_artifact`, `claim_step`, `cited_kind`, `cited_step`,
    `cited_content`, `verified`, `reason`.

    The relational gates decide first, in one ordered CASE over equi-joins; only entries that pass them reach the text
    rules, which are given the span with what boundaries can see around it and not the whole artifact.
    """
    e = account(runs.entries)
    claims = runs.claims.select("run_id", "claim_id", F.col("artifact_id").alias("claim_artifact"))
    made = step_outputs(runs.steps)
    maker = made.select("run_id", F.col("artifact_id").alias("claim_artifact"), F.col("step_id").alias("claim_step"), F.col("inputs").alias("claim_inputs"))
    source = made.select("run_id", F.col("artifact_id").alias("cited_id"), F.col("step_id").alias("cited_step"))
    cited = runs.artifacts.select("run_id", F.col("artifact_id").alias("cited_id"), F.col("kind").alias("cited_kind"), F.col("content").alias("cited_content"))
    declared = runs.assumptions.select("run_id", F.col("id").alias("label"), F.lit(True).alias("declared"))
    loops = by_run(step_loops(runs))
    e = e.join(claims, ["run_id", "claim_id"]).join(maker, ["run_id", "claim_artifact"], "left").join(cited, ["run_id", "cited_id"], "left").join(source, ["run_id", "cited_id"], "left").join(declared, ["run_id", "label"], "left")
    e = e.join(loops.select("run_id", F.col("step_id").alias("claim_step"), F.col("loop").alias("claim_loop")), ["run_id", "claim_step"], "left")
    e = e.join(loops.select("run_id", F.col("step_id").alias("cited_step"), F.col("loop").alias("cited_loop")), ["run_id", "cited_step"], "left")
    own = is_root(F.col("cited_kind")) & ((F.col("cited_step") == F.col("claim_step")) | F.coalesce(F.col("claim_loop") == F.col("cited_loop"), F.lit(False)))
    in_range = (F.col("cited_start") >= 0) & (F.col("cited_start") < F.col("cited_end")) & (F.col("cited_end") <= F.length("cited_content"))
    early = (
        F.when(F.col("account_type") == "PRIOR", "prior_never_funds")
        .when(F.col("account_type") == "ASSUMPTION", F.when(F.col("declared"), OK).otherwise("assumption_undeclared"))
        .when(F.col("cited_kind").isNull(), "artifact_unknown")
        .when(F.col("cited_id") == F.col("claim_artifact"), "self_citation")
        .when(F.col("claim_step").isNull() | ~F.array_contains("claim_inputs", F.col("cited_id")), "not_reachable_from_step")
        .when(own, "self_citation")
        .when(~F.coalesce(in_range, F.lit(False)), "span_out_of_range")
        .when(is_blank(F.col("quoted_span")), "no_quoted_span")
    )
    e = e.withColumn("early", early)
    lo = F.greatest(F.col("cited_start") - AROUND, F.lit(0))
    near = F.when(F.col("early").isNull(), F.substring("cited_content", lo + 1, F.col("cited_end") + AROUND - lo))
    late = quote_gate(near, F.coalesce(F.col("cited_start") - lo, F.lit(0)), F.coalesce(F.col("cited_end") - lo, F.lit(0)), F.col("quoted_span"))
    e = e.withColumn("reason", F.coalesce("early", late))
    return e.withColumn("verified", F.col("reason") == OK).drop("early", "declared", "claim_loop", "cited_loop", "claim_inputs")


def worst_reasons(verified: DataFrame) -> DataFrame:
    """(run_id, claim_id, worst): the earliest gate that an entry of the claim failed."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), F.lit(0)), F.lit(len(REASONS) + 1))
    return verified.where(~F.col("verified") & (F.col("reason") != "")).groupBy("run_id", "claim_id").agg(F.min(F.struct(rank.alias("rank"), "reason"))["reason"].alias("worst"))
