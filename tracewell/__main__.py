"""python -m tracewell [audit|check|convert|propose] PATH: the API from a shell. Exit code 0 closes, 1 fails, 2 can't be
checked."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.audit import audit, check_trace, undeclared_tools
from tracewell.operators import auditability, propose, report
from tracewell.sources.chat import TOOL_CHARS
from tracewell.sources.files import FORMATS, read_runs, to_documents, write_runs

COMMANDS = ("audit", "check", "convert", "propose")
#: A document so many times as large as its log is worth a line.
LARGE = 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path")
    p.add_argument("--from", dest="form", choices=FORMATS)
    p.add_argument("--json", action="store_true")
    p.add_argument("--chain", action="store_true", help="every claim's chain, a hop a line")
    p.add_argument("--quiet", action="store_true", help="nothing but the exit code, and what it is for on stderr")
    p.add_argument("--min-reachable", type=float)
    p.add_argument("--max-tool-chars", type=int, default=TOOL_CHARS)
    for kind, what in (("model-text", "hand the model's text back"), ("verbatim", "hand on documents word for word"), ("external", "reply with what is from outside")):
        p.add_argument(f"--tool-returns-{kind}", action="append", default=[], metavar="NAME", help=f"tools that {what}")
    p.add_argument("--require-declared-tools", action="store_true", help="fail runs with replies of tools that nothing was declared of")
    p.add_argument("--script", help="propose: a JSON file of answers, {task: {text or claim: answer}}, instead of the sentences as they stand")
    p.add_argument("--on-demand", action="store_true", help="propose: credit only claims that the answer leads to")
    p.add_argument("-o", "--output")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "audit")
    p = parser()
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    options = {}
    if a.form in ("openai", "otel") or a.form is None and (a.tool_returns_model_text or a.tool_returns_verbatim or a.tool_returns_external):
        declared = {"model_text_tools": a.tool_returns_model_text, "verbatim_tools": a.tool_returns_verbatim, "external_tools": a.tool_returns_external}
        options = {k: frozenset(v) for k, v in declared.items() if v}
    if a.max_tool_chars != TOOL_CHARS:
        options["tool_chars"] = a.max_tool_chars
    shown: list[str] = []
    if a.command in ("convert", "propose"):
        if not a.output:
            p.error(f"{a.command} needs --output")
        runs, bad, _ = read_runs(spark, a.path, a.form, **options)
        if a.command == "propose":
            proposer = propose.scripted(json.load(open(a.script, encoding="utf-8"))) if a.script else propose.verbatim
            runs = propose.post(runs, proposer, a.on_demand)
        write_runs(runs, a.output)
        errors = [f"{r.run_id}: {r.error}" for r in bad.toLocalIterator()]
        logs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.path).select(F.col("path").alias("run_id"), F.col("length"))
        big = report.sizes(runs, to_documents(runs)).join(logs, "run_id").where(F.col("bytes") >= LARGE * F.col("length"))
        shown = errors + [f"{r.run_id}: {r.bytes} bytes of {r.length}; its steps list {r.inputs} inputs" for r in big.toLocalIterator()]
        codes = {2} if errors else {0}
    elif a.command == "check":
        found, bad = check_trace(spark, a.path, a.form, a.min_reachable, a.require_declared_tools, **options)
        if a.json:
            notes = report.reading(read_runs(spark, a.path, a.form, **options)[2])
            rows = found.join(notes.withColumnRenamed("json", "reading"), "run_id", "left")
            shown = [report.writable(r.j) for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
        elif not a.quiet:
            runs, _, notes = read_runs(spark, a.path, a.form, **options)
            truncated = notes.where("note = 'truncated'").select("run_id", "artifact_id")
            shown = [r.text for r in report.check_lines(found, auditability.findings(runs, truncated)).toLocalIterator()]
            shown += [report.writable(r.text) for r in report.echo_lines(notes).toLocalIterator()]
        codes = {r.exit_code for r in found.select("exit_code").distinct().collect()} | ({2} if bad.take(1) else set())
    else:
        done = audit(spark, a.path, a.form, a.require_declared_tools, **options)
        if not a.quiet:
            shown = [report.writable(r[1]) for r in (report.payloads(done.runs, done.claims, done.balance) if a.json else report.summary(done.balance, done.claims)).toLocalIterator()]
            shown += [r.text for r in report.chain_view(done.claims).toLocalIterator()] if a.chain else []
            shown += [report.writable(r.text) for r in report.echo_lines(done.notes).toLocalIterator()] if not a.json else []
        if a.require_declared_tools:
            for r in undeclared_tools(done.notes).groupBy("run_id").count().toLocalIterator():
                print(f"{r.run_id}: {r['count']} replies of tools that nothing was declared of", file=sys.stderr)
        codes = {r.exit_code for r in done.balance.select("exit_code").distinct().collect()} | ({2} if done.bad_runs.take(1) else set())
    if shown:
        print("\n".join(shown))
    return 1 if 1 in codes else max(codes, default=2)


if __name__ == "__main__":
    sys.exit(main())
