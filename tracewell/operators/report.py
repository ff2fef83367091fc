"""Reports of one run as text, and payloads of every run as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.balance import final_claims, status_counts
from tracewell.plans.model import STATUSES, Runs


def payloads(runs: Runs, audits: DataFrame, balance: DataFrame) -> DataFrame:
    """(run_id, json): the audit of each run as one JSON object, its final claims in the order of their ids."""
    finals = final_claims(runs, audits)
    counts = status_counts(finals)
    claim = F.struct("claim_id", "status", "text", "depth", "chain", "break_claim_id", "break_step_id", "break_reason")
    claims = finals.groupBy("run_id").agg(F.sort_array(F.collect_list(claim)).alias("claims"))
    x = balance.drop("laundered", "unchecked", "claims").join(counts, "run_id", "left").join(claims, "run_id", "left")
    answer = F.struct(F.col("total").alias("letters"), "claimed", "closed", "mostly_unclaimed")
    body = F.struct("coverage", "laundering_rate", "books_balance", answer.alias("answer"), F.struct(*STATUSES).alias("counts"), "claims", "reasons", "exit_code")
    return x.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def percent(part: Column, whole: Column) -> Column:
    """A share in whole per cent, never rounded up."""
    return F.coalesce(F.floor(F.try_divide(100 * part, whole)), F.lit(0))


def summary(balance: DataFrame, audits: DataFrame) -> DataFrame:
    """(run_id, text): what a reader of one run wants to know, a line each."""
    breaks = audits.where("status IN ('laundered', 'unsupported', 'prior_only', 'circular')").groupBy("run_id").agg(F.sort_array(F.collect_list(F.format_string("  %s: %s, breaks at %s (%s)", "claim_id", "status", F.coalesce("break_step_id", F.lit("-")), "break_reason"))).alias("lines"))
    x = balance.join(breaks, "run_id", "left")
    head = F.format_string(
        "%s\n%d of %d final claims close; %d of %d letters of the answer under a claim (%d%%), %d under one that closes",
        F.when(F.col("books_balance"), "books balance").otherwise("books do not balance"), "closing", "final_claims", "claimed", "total", percent(F.col("claimed"), F.col("total")), "closed",
    )
    return x.select("run_id", F.concat_ws("\n", head, F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")).alias("text"))


def chain_view(audits: DataFrame) -> DataFrame:
    """(run_id, claim_id, text): a claim's chain, a hop a line."""
    hops = F.transform("chain", lambda h: F.format_string("  -> %s  \"%s\"", h["account"], h["quote"]))
    return audits.select("run_id", "claim_id", F.concat_ws("\n", F.format_string("%s [%s]", "claim_id", "status"), F.array_join(hops, "\n")).alias("text"))


def check_lines(checked: DataFrame, found: DataFrame, names: int = 6) -> DataFrame:
    """(run_id, text) of auditability.check() and findings(): the verdict, what an audit can reach, and the subjects of
    each finding, the first `names` of them."""
    per = found.groupBy("run_id", "code", "is_note").agg(F.sort_array(F.collect_list("subject")).alias("all"))
    shown = F.concat(F.array_join(F.slice("all", 1, names), ", "), F.when(F.size("all") > names, F.concat(F.lit(", +"), (F.size("all") - names).cast("string"), F.lit(" more"))).otherwise(""))
    line = F.format_string("  %s %s: %s", F.when(F.col("is_note"), "note").otherwise("finding"), "code", shown)
    lines = per.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("is_note", "code", line.alias("line")))).alias("x")).select("run_id", F.transform("x", lambda v: v["line"]).alias("lines"))
    share = F.when(F.col("reachable_share").isNull(), F.lit("no text to reach")).otherwise(F.format_string("%d%% of its text can be reached", F.floor(100 * F.col("reachable_share"))))
    head = F.format_string("%s: %d steps, %d artifacts, %s", "verdict", "steps", "artifacts", share)
    return checked.join(lines, "run_id", "left").select("run_id", F.concat_ws("\n", head, F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")).alias("text"))


def reading(notes: DataFrame) -> DataFrame:
    """(run_id, json): what the reader of a log noted, a list for every kind of note."""
    value = F.coalesce("detail", F.to_json(F.struct("artifact_id")))
    per = notes.groupBy("run_id", "note").agg(F.sort_array(F.collect_list(value)).alias("items"))
    part = F.concat(F.to_json(F.array("note")), F.lit(":["), F.array_join("items", ","), F.lit("]"))
    part = F.regexp_replace(part, r"^\[(.*?)\]:", "$1:")
    return per.groupBy("run_id").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(part)), ","), F.lit("}")).alias("json"))


def echo_lines(notes: DataFrame, most: int = 10) -> DataFrame:
    """(run_id, text): the replies kept as evidence that may be the model's own text; a note moves no exit code."""
    x = notes.where("note IN ('echo_notes', 'cleared_notes')")
    field = lambda k: F.get_json_object("detail", f"$.{k}")
    cleared = F.when(F.col("note") == "cleared_notes", F.concat(F.lit(" (cleared by a declaration of "), field("cleared_by"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("  "), F.col("artifact_id"), F.lit(" "), field("kind"), F.lit(": "), field("line"), cleared)
    per = x.groupBy("run_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    more = F.when(F.size("lines") > most, F.concat(F.lit("\n  +"), (F.size("lines") - most).cast("string"), F.lit(" more"))).otherwise("")
    return per.select("run_id", F.concat(F.lit("replies that may be the model's own text:\n"), F.array_join(F.slice("lines", 1, most), "\n"), more).alias("text"))


def sizes(runs: Runs, documents: DataFrame) -> DataFrame:
    """(run_id, bytes, inputs) of documents(run_id, json): what a run takes as a document, and the inputs that its steps
    list, which grow with the square of its length."""
    inputs = runs.steps.groupBy("run_id").agg(F.sum(F.size("inputs")).alias("inputs"))
    return documents.select("run_id", F.octet_length("json").cast("long").alias("bytes")).join(inputs, "run_id", "left").na.fill(0, ["inputs"])


def writable(text: str) -> str:
    """A text with halves of surrogate pairs, which no file takes, as their escapes."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")
