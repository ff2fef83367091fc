"""Studies over audited runs: scores against labels, samples, placebos, diagnoses and comparisons of readers."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracewell.functions.locate import tolerant
from tracewell.functions.textview import normal
from tracewell.operators.balance import final_claims, injection_points
from tracewell.plans.model import Runs, is_root
from tracewell.sources.files import to_documents

#: Shares of a quotation's words that tell an edited one from a partial one and that from an invented one.
EDITED, PARTIAL = 0.9, 0.6
_WORD = regex.compile(r"[^\W_]+")


def _seeded(seed: int, *columns: str) -> Column:
    """A text that orders rows at random and repeats exactly."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def scores(runs: Runs, audits: DataFrame, numbers: DataFrame, labels: DataFrame) -> DataFrame:
    """What the audit of each run says against its label.

    numbers(run_id, step_id, number): the history step behind a step; a break elsewhere, as at the answer, comes one
    after the last. labels(run_id, label_step): the step that is to blame, or null. exact: the earliest break is the
    labelled step; label_hit: it is among the breaks.
    """
    last = numbers.groupBy("run_id").agg((F.max("number") + 1).alias("answer_step"))
    finals = final_claims(runs, audits).groupBy("run_id").agg(F.count("*").alias("final_claims"), F.count_if(F.col("status") == "laundered").alias("laundered"))
    x = runs.run_ids().join(last, "run_id", "left").join(finals, "run_id", "left").join(labels.select("run_id", "label_step"), "run_id", "left")
    x = x.na.fill(1, ["answer_step"]).na.fill(0, ["final_claims", "laundered"])
    found = injection_points(runs, audits).select("run_id", F.col("break_step_id").alias("step_id")).join(numbers, ["run_id", "step_id"], "left").join(last, "run_id", "left")
    breaks = found.groupBy("run_id").agg(F.sort_array(F.collect_set(F.coalesce("number", "answer_step", F.lit(1)))).alias("break_steps"))
    x = x.join(breaks, "run_id", "left").withColumn("break_steps", F.coalesce("break_steps", F.array().cast("array<int>")))
    first, label = F.get("break_steps", F.lit(0)), F.col("label_step")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return x.select(
        "run_id", (F.size("break_steps") > 0).alias("flagged"), "break_steps", first.alias("break_step"), "label_step", yes(first == label).alias("exact"),
        yes(F.array_contains("break_steps", label)).alias("label_hit"), yes(F.abs(first - label) <= 1).alias("within_one"), "answer_step", "final_claims",
        F.coalesce(F.try_divide("laundered", "final_claims"), F.lit(0.0)).alias("laundering_rate"),
    )


def roll_up(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(population, n, flagged, exact, label_hit, within_one) of scores() with labels(run_id, labelled, at_boundary,
    category, subcategory): labelled runs, those whose label can be reached and those where it lies beyond a tool, the
    first by category, and runs without a label."""
    x = scored.join(labels.select("run_id", "labelled", "at_boundary", "category", "subcategory"), "run_id")
    named = F.concat(F.lit("reachable: "), F.concat_ws(" / ", F.coalesce("category", F.lit("none")), F.coalesce("subcategory", F.lit("none"))))
    reach = F.col("labelled") & ~F.col("at_boundary")
    tags = F.array(F.when(F.col("labelled"), "labelled").otherwise("clean"), F.when(reach, "reachable"), F.when(F.col("labelled") & F.col("at_boundary"), "beyond"), F.when(reach, named))
    rows = x.withColumn("population", F.explode(F.array_compact(tags)))
    return rows.groupBy("population").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("flagged", "exact", "label_hit", "within_one")))


def placebo(steps: DataFrame, unit: str, step: str, beyond: str, seed: int = 0) -> DataFrame:
    """(unit, beyond) of steps(unit, step, beyond): whether a step drawn at random from the unit lies beyond."""
    return steps.groupBy(unit).agg(F.min_by(beyond, F.struct(_seeded(seed, unit, step), step)).alias("beyond"))


def natural_rate(spans: DataFrame, labels: DataFrame, unit: str) -> DataFrame:
    """(n, hit, rate): spans(unit, start, end) that overlap one of labels(unit, r_start, r_end)."""
    found = spans.join(labels, unit).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))).select(unit, "start", "end").distinct().withColumn("hit", F.lit(1))
    x = spans.join(found, [unit, "start", "end"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    return x.withColumn("rate", F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)))


def enriched(rows: DataFrame, unit: str, has: str, limit: int, share: float = 0.6, seed: int = 0) -> DataFrame:
    """At most `limit` rows with `place`, their number in one seeded order: round(limit * share) that have the property
    and as many others as are left. A smaller limit is not always a prefix of a larger one's rows, its order is."""
    order = _seeded(seed, unit)
    most = round(limit * share)
    some = rows.where(F.col(has)).orderBy(order, unit).limit(most)
    others = rows.where(~F.col(has)).orderBy(order, unit).limit(limit - most)
    chosen = some.union(others).withColumn("_order", _seeded(seed + 1, unit))
    return chosen.withColumn("place", F.row_number().over(W.orderBy("_order", unit))).drop("_order")  # `limit` rows


def matched_words(quote: str, source: str) -> tuple[int, int]:
    """(words of the quotation that stand in order in the source around its longest common run, all its words)."""
    q, s = (_WORD.findall(normal(t)) for t in (quote, source))
    run = difflib.SequenceMatcher(None, s, q, autojunk=False).find_longest_match()
    if not run.size:
        return 0, len(q)
    slack, begin = len(q) // 2, run.a - run.b
    near = s[max(0, begin - slack) : begin + len(q) + slack]
    return sum(b.size for b in difflib.SequenceMatcher(None, near, q, autojunk=False).get_matching_blocks()), len(q)


_LIKENESS = T.StructType([T.StructField("share", T.DoubleType()), T.StructField("found", T.BooleanType()), T.StructField("one_off", T.BooleanType())])


@F.pandas_udf(_LIKENESS)
def likeness(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    """How much of a quotation its source has; whether it can be located; whether at most one word of five or more is off."""
    out = []
    for q, s in zip(quote, source.fillna(""), strict=True):
        hit, n = matched_words(q, s)
        out.append((hit / n if n else 0.0, tolerant(s, q) is not None, n >= 5 and n - hit <= 1))
    return pd.DataFrame(out, columns=["share", "found", "one_off"])


def drop_buckets(runs: Runs, dropped: DataFrame) -> DataFrame:
    """(run_id, claim_id, bucket): why every credit that was offered for a claim was dropped, of claims that had any.

    dropped(run_id, claim_id, artifact_id, quote, reason, proposed_by); credits that the pipeline found by itself were
    not offered by anyone.
    """
    offered = dropped.where("proposed_by <> 'verbatim'").join(runs.artifacts.select("run_id", "artifact_id", "content"), ["run_id", "artifact_id"], "left")
    quoted = F.contains("reason", F.lit("verbatim"))
    x = offered.withColumn("like", F.when(quoted, likeness("quote", F.coalesce("content", F.lit("")))))
    has = lambda *parts: F.bool_or(F.col("reason").rlike("|".join(parts)))
    per = x.groupBy("run_id", "claim_id").agg(F.max("like.share").alias("best"), F.bool_or("like.found").alias("found"), F.bool_or("like.one_off").alias("one_off"), has("partially overlaps", "no whole claim").alias("straddles"), has("not among the step").alias("elsewhere"))
    words = F.when(F.col("found"), "quote_near_verbatim").when((F.col("best") >= EDITED) | F.col("one_off"), "quote_edited").when(F.col("best") >= PARTIAL, "quote_partial").otherwise("quote_fabricated")
    return per.select("run_id", "claim_id", F.when(F.col("best").isNotNull(), words).when(F.col("straddles"), "quote_straddles_claims").when(F.col("elsewhere"), "wrong_artifact_cited").otherwise("dropped_other").alias("bucket"))


def diagnosis(runs: Runs, audits: DataFrame, dropped: DataFrame) -> DataFrame:
    """(run_id, claim_id, bucket) of every failing claim of a final answer: at which hop it broke, and why."""
    failing = final_claims(runs, audits).join(injection_points(runs, audits).select("run_id", "claim_id"), ["run_id", "claim_id"], "left_semi")
    buckets = drop_buckets(runs, dropped)
    at = audits.select("run_id", F.col("claim_id").alias("break_claim_id"), F.col("status").alias("break_status"))
    why = buckets.select("run_id", F.col("claim_id").alias("break_claim_id"), "bucket")
    grouped = runs.entries.groupBy("run_id", "claim_id", "account").agg(F.bool_and(F.col("grp") != "").alias("grouped"))
    x = failing.withColumn("account", F.get("chain", F.lit(0))["account"]).join(at, ["run_id", "break_claim_id"], "left").join(why, ["run_id", "break_claim_id"], "left").join(grouped, ["run_id", "claim_id", "account"], "left")
    drop, own = F.coalesce("bucket", F.lit("no_credit_offered")), F.col("break_claim_id") == F.col("claim_id")
    bucket = (
        F.when(F.contains("break_reason", F.lit("not fully accounted")), "unaccounted_span")
        .when(own, F.concat(F.lit("answer_hop:"), F.when(F.col("status") == "prior_only", drop).otherwise(F.col("status"))))
        .when((F.col("status") == "laundered") & (F.col("break_status") == "prior_only"), F.concat(F.when(F.coalesce("grouped", F.lit(False)), "group_member:").otherwise(""), drop))
        .when((F.col("status") == "laundered") & (F.col("break_status") == "unsupported"), "upstream_unsupported")
        .otherwise("other")
    )
    return x.select("run_id", "claim_id", bucket.alias("bucket"))


@F.pandas_udf(T.StringType())
def _fingerprint(document: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        run = json.loads(text)
        return hashlib.sha256(json.dumps({k: run.get(k) or [] for k in ("artifacts", "steps")}, sort_keys=True).encode()).hexdigest()[:16]

    return document.map(one)


def fingerprints(runs: Runs) -> DataFrame:
    """(run_id, fingerprint): 16 hex digits that change when an artifact or a step of the run does."""
    return to_documents(runs).select("run_id", _fingerprint("json").alias("fingerprint"))


def reader_differences(one: Runs, other: Runs) -> DataFrame:
    """(run_id, ord, one, other) where two readings of a run differ in an artifact's text or in whether a chain may end
    on it; a side that has no such artifact is null."""

    def shape(runs: Runs, name: str) -> DataFrame:
        return runs.artifacts.select("run_id", "ord", F.struct(F.when(is_root(F.col("kind")), "root").otherwise("derived").alias("kind"), "content").alias(name))

    met = shape(one, "one").join(shape(other, "other"), ["run_id", "ord"], "full_outer")
    return met.where(~F.col("one").eqNullSafe(F.col("other")))
