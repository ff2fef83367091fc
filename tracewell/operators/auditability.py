"""Before an audit: what a recording lets an audit see. Findings are read off rows that meet in windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewell.functions.udfs import normal_form
from tracewell.plans.model import MATCHABLE, Runs, is_blank, is_root, shared_folder

FATAL = ("no_final_answer", "no_model_text", "no_steps")
NOTES = ("mixed_outputs", "no_outputs", "duplicate_content")


def _woven(runs: Runs) -> DataFrame:
    """A row for every artifact ('a'), step ('s') and output of a step ('o') without the texts, with what it is to the
    others: orphan_derived and orphan_root of artifacts, class and mixed of steps.

    Rows meet in windows over one exchange, where joins would sort both sides of each finding in one task. Of texts only
    those roots' are carried whose normal form may be shorter than MATCHABLE; no form drops ASCII letters or digits.
    """
    k, n, part = F.col("kind"), F.length("content"), F.col("part")
    long = is_root(k) & (n >= MATCHABLE)
    sure = F.col("content").rlike(f"(?:[A-Za-z0-9][^A-Za-z0-9]*){{{MATCHABLE}}}")
    rows = [
        runs.artifacts.select("run_id", F.lit("a").alias("part"), "artifact_id", "kind", is_blank(F.col("content")).alias("blank"), n.alias("n_chars"), (long & sure).alias("long"), F.when(long & ~sure, F.col("content")).alias("unsure")),
        runs.input_counts().select("run_id", F.lit("s").alias("part"), "step_id", "ord", "n_inputs"),
        runs.steps.select("run_id", F.lit("o").alias("part"), F.explode("outputs").alias("artifact_id"), "step_id"),
        runs.taken().select("run_id", F.lit("t").alias("part"), "artifact_id"),
    ]
    x = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), rows).repartition("run_id")
    same, step, run = W.partitionBy("run_id", "artifact_id"), W.partitionBy("run_id", "step_id"), W.partitionBy("run_id")
    named, of = F.col("artifact_id").isNotNull(), lambda p: part == p
    x = x.withColumns({
        "made": named & F.bool_or(of("o")).over(same), "taken": named & F.bool_or(of("t")).over(same), "known": named & F.bool_or(of("a")).over(same),
        "model": F.coalesce(F.bool_or(of("a") & ~is_root(k)).over(same), F.lit(False)), "tool": F.coalesce(F.bool_or(of("a") & (k == "tool_result")).over(same), F.lit(False)),
    }).withColumn("stepped", F.bool_or(of("s")).over(run)).where(~of("t"))
    put = of("o") & F.col("known")
    x = x.withColumns({"puts": F.bool_or(put).over(step), "puts_model": F.bool_or(put & F.col("model")).over(step), "puts_tool": F.bool_or(put & F.col("tool")).over(step)})
    idle = of("a") & is_root(k) & ~F.col("taken") & F.col("stepped")
    x = x.withColumn("orphan_root", idle & (F.col("long") | F.coalesce(F.length(normal_form(F.when(idle, F.col("unsure")))) >= MATCHABLE, F.lit(False))))
    class_ = F.when(~F.col("puts"), "silent").when(F.col("puts_model"), "reachable").when(F.col("puts_tool"), "opaque").otherwise("ingest")
    return x.select(
        "run_id", "part", "artifact_id", "step_id", "ord", "kind", "blank", "n_chars", "n_inputs", "orphan_root", (of("a") & ~is_root(k) & ~F.col("made")).alias("orphan_derived"),
        F.when(of("s"), class_).alias("class"), (of("s") & F.col("puts_model") & F.col("puts_tool")).alias("mixed"),
    )


def step_classes(runs: Runs) -> DataFrame:
    """(run_id, step_id, class, mixed, n_inputs): silent, reachable (wrote model text), opaque (a tool) or ingest."""
    return _woven(runs).where("part = 's'").select("run_id", "step_id", "class", "mixed", "n_inputs")


#: Findings on a row of _woven(): the condition and whose name it is under.
_OF_ROWS = {
    "undeclared_inputs": ("class = 'reachable' AND n_inputs = 0", "step_id"), "orphan_derived": ("orphan_derived", "artifact_id"), "empty_artifact": ("part = 'a' AND blank", "artifact_id"),
    "orphan_root": ("orphan_root", "artifact_id"), "mixed_outputs": ("mixed", "step_id"),
}
#: Findings on a row of _by_run(): the condition and the list of names, if any.
_OF_RUNS = {
    "no_final_answer": ("answers = 0", None), "multiple_final_answers": ("answers > 1", "answer_ids"), "no_model_text": ("steps > 0 AND reachable_steps = 0", None), "no_steps": ("steps = 0", None),
    "no_outputs": ("silent_steps > 0", "silent_ids"),
}


def _by_run(woven: DataFrame) -> DataFrame:
    """A row for every run: the counters, how many rows each finding has, and the names that findings list."""
    k, n, blank, a = F.col("kind"), F.col("n_chars"), F.col("blank"), F.col("part") == "a"
    final = F.when(k == "final_answer", F.col("artifact_id"))
    silent = F.when(F.col("class") == "silent", F.struct("ord", "step_id"))
    return woven.groupBy("run_id").agg(
        F.count_if(a).alias("artifacts"),
        F.count_if(k == "document").alias("documents"),
        F.count_if(k == "tool_result").alias("tool_results"),
        F.count_if(~is_root(k)).alias("derived"),
        F.count_if(~is_root(k) & blank).alias("empty_derived"),
        F.count_if((k == "tool_result") & blank).alias("empty_tool_results"),
        F.coalesce(F.sum(F.when(is_root(k), n).otherwise(0)), F.lit(0)).alias("root_chars"),
        F.coalesce(F.sum(F.when(k == "tool_result", n).otherwise(0)), F.lit(0)).alias("tool_result_chars"),
        F.count_if(F.col("part") == "s").alias("steps"),
        *(F.count_if(F.col("class") == c).alias(f"{c}_steps") for c in ("reachable", "opaque", "ingest", "silent")),
        F.count_if(k == "final_answer").alias("answers"),
        *(F.count_if(F.expr(when)).alias(f"n_{code}") for code, (when, _) in _OF_ROWS.items()),
        F.sort_array(F.collect_list(final)).alias("answer_ids"),
        F.transform(F.sort_array(F.collect_list(silent)), lambda s: s["step_id"]).alias("silent_ids"),
    )


def reachable_share() -> Column:
    """Model text among model text and tool results, empty ones apart; null where there is neither."""
    told, tools = F.col("derived") - F.col("empty_derived"), F.col("tool_results") - F.col("empty_tool_results")
    return F.try_divide(told, told + tools)


def duplicate_content(artifacts: DataFrame) -> DataFrame:
    """(run_id, ids): artifacts of a run with the same text, that is not blank."""
    same = artifacts.where(~is_blank(F.col("content"))).groupBy("run_id", F.sha2("content", 256).alias("key"))
    return same.agg(F.sort_array(F.collect_list("artifact_id")).alias("ids")).where(F.size("ids") > 1).select("run_id", "ids")


def findings(runs: Runs, truncated: DataFrame | None = None) -> DataFrame:
    """(run_id, code, subject, fatal, is_note). truncated(run_id, artifact_id): what the recorder cut short."""
    shared_folder(runs.artifacts.sparkSession)
    woven = _woven(runs).checkpoint()
    entry = lambda when, code, subject: F.when(F.expr(when), F.struct(F.lit(code).alias("code"), subject.alias("subject")))
    each = lambda df, *entries: df.select("run_id", F.explode(F.array_compact(F.array(*entries))).alias("x")).select("run_id", "x.*")
    found = [
        each(woven, *(entry(when, code, F.col(name)) for code, (when, name) in _OF_ROWS.items())),
        each(_by_run(woven), *(entry(when, code, F.array_join(ids, ", ") if ids else F.lit("-")) for code, (when, ids) in _OF_RUNS.items())),
        duplicate_content(runs.artifacts).select("run_id", F.lit("duplicate_content").alias("code"), F.array_join("ids", ", ").alias("subject")),
    ]
    if truncated is not None:
        found.append(truncated.select("run_id", F.lit("truncated").alias("code"), F.col("artifact_id").alias("subject")))
    return reduce(DataFrame.unionByName, found).select("run_id", "code", "subject", F.col("code").isin(*FATAL).alias("fatal"), F.col("code").isin(*NOTES).alias("is_note"))


def check(runs: Runs, truncated: DataFrame | None = None, min_reachable: float | None = None) -> DataFrame:
    """A row for every run: the counters, reachable_share, findings and notes by number, and the verdict."""
    same = runs.artifacts.where(~is_blank(F.col("content"))).groupBy("run_id", F.sha2("content", 256).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    x = _by_run(_woven(runs)).join(same.groupBy("run_id").agg(F.count("*").alias("n_duplicate_content")), "run_id", "left")
    cut = F.lit(0)
    if truncated is not None:
        x, cut = x.join(truncated.groupBy("run_id").agg(F.count("*").alias("n_truncated")), "run_id", "left"), F.coalesce("n_truncated", F.lit(0))
    number = {code: F.col(f"n_{code}") for code in _OF_ROWS} | {code: F.expr(when).cast("long") for code, (when, _) in _OF_RUNS.items()}
    number |= {"duplicate_content": F.coalesce("n_duplicate_content", F.lit(0)), "truncated": cut}
    total = lambda codes: reduce(Column.__add__, (number[c] for c in codes)).cast("long")
    x = x.withColumns({"reachable_share": reachable_share(), "n_findings": total(c for c in number if c not in NOTES), "n_notes": total(c for c in number if c in NOTES), "fatal": total(FATAL) > 0})
    thin = F.coalesce(F.col("reachable_share") < min_reachable, F.lit(False)) if min_reachable is not None else F.lit(False)
    verdict = F.when(F.col("fatal") | (F.col("derived") == F.col("empty_derived")), "unauditable").when(thin | (F.col("n_findings") > 0), "partial").otherwise("auditable")
    x = x.withColumn("verdict", verdict).withColumn("exit_code", F.when(F.col("verdict") == "auditable", 0).otherwise(1))
    return x.drop("fatal", "answers", "answer_ids", "silent_ids", "n_duplicate_content", "n_truncated", *(f"n_{code}" for code in _OF_ROWS))
