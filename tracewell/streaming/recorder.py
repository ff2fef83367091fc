"""Callback events of live agents as runs: starts and ends paired, and a prompt's inputs recovered from its bytes.

EVENTS come from a table or from a stream; a stream's are written to a table as they arrive, and runs are built from
it when a trace is over, so late events need no special case.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.textview import normal
from tracewell.plans.model import ARTIFACTS, ASSUMPTIONS, CLAIMS, ENTRIES, MATCHABLE, STEPS, Runs

EVENTS = "trace_id string, seq long, event string, call_id string, name string, text string, documents array<string>"
#: The events: a retriever ends, a tool starts and ends, a model starts (text: its prompt) and ends, an error of either.
KINDS = ("retriever_end", "tool_start", "tool_end", "model_start", "model_end", "error")


def seen_in(prompt: str, known: list[tuple[str, str, bool]]) -> list[str]:
    """Which artifacts (id, content, root), oldest first, a prompt holds: longest first, each place once, of equal
    texts the latest; short roots are not looked for."""
    text = normal(prompt)
    latest = {(n, root): name for name, content, root in known if (n := normal(content)) and (not root or len(n) >= MATCHABLE)}
    found, taken = set(), []
    for (content, _), name in sorted(latest.items(), key=lambda x: -len(x[0][0])):
        at = text.find(content)
        while at >= 0 and any(a < at + len(content) and at < b for a, b in taken):
            at = text.find(content, at + 1)
        if at >= 0:
            taken.append((at, at + len(content)))
            found.add(name)
    return [name for name, *_ in known if name in found]


def _build(events: pd.DataFrame) -> pd.DataFrame:
    trace = events["trace_id"].iloc[0]
    known: list[tuple[str, str, bool]] = []
    open_: dict[str, tuple[str, list[str]]] = {}
    out: list[dict] = []

    def artifact(kind: str, content: str, title: str) -> str:
        name = f"{kind[0]}{len(known)}"
        known.append((name, content, kind in ("document", "tool_result")))
        out.append({"run_id": trace, "part": "artifact", "id": name, "kind": kind, "content": content, "title": title, "inputs": [], "outputs": [], "ord": len(out)})
        return name

    def step(kind: str, inputs: list[str], outputs: list[str]) -> None:
        out.append({"run_id": trace, "part": "step", "id": f"{kind}{len(out)}", "kind": kind, "content": "", "title": "", "inputs": inputs, "outputs": outputs, "ord": len(out)})

    for e in events.sort_values("seq").to_dict("records"):
        text = e["text"] or ""
        if e["event"] == "retriever_end":
            made = [artifact("document", d, e["name"] or "") for d in (e["documents"] if e["documents"] is not None else []) if d and d.strip()]
            step("retrieve", [], made)
        elif e["event"] == "tool_start":
            open_[e["call_id"]] = (e["name"] or "tool", seen_in(text, known))
        elif e["event"] == "model_start":
            open_[e["call_id"]] = ("model", seen_in(text, known))
        elif e["event"] == "error":
            open_.pop(e["call_id"], None)
        elif e["event"] in ("tool_end", "model_end"):
            name, inputs = open_.pop(e["call_id"], ("tool", []))
            if text.strip():
                tool = e["event"] == "tool_end"
                step("tool" if tool else "generate", inputs, [artifact("tool_result" if tool else "intermediate", text, name)])
    made = [x for x in out if x["part"] == "artifact"]
    if made and made[-1]["kind"] == "intermediate":  # a recording that stops on a tool doesn't say what the user saw
        made[-1]["kind"] = "final_answer"
    return pd.DataFrame(out, columns=["run_id", "part", "id", "kind", "content", "title", "inputs", "outputs", "ord"], dtype=object)


def to_runs(events: DataFrame) -> Runs:
    """Runs of the traces in EVENTS; one grouped map a trace, since what a prompt holds depends on what came before."""
    built = events.groupBy("trace_id").applyInPandas(_build, "run_id string, part string, id string, kind string, content string, title string, inputs array<string>, outputs array<string>, ord int")
    spark = events.sparkSession
    a = built.where("part = 'artifact'").select("run_id", F.col("id").alias("artifact_id"), "kind", "content", "title", "ord").to(spark.createDataFrame([], ARTIFACTS).schema)
    s = built.where("part = 'step'").select("run_id", F.col("id").alias("step_id"), "kind", "inputs", "outputs", "ord").to(spark.createDataFrame([], STEPS).schema)
    return Runs(a, s, *(spark.createDataFrame([], x) for x in (CLAIMS, ENTRIES, ASSUMPTIONS)))


def record(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """An extension: JSON events as they arrive under `source`, appended to the Parquet table `sink` by trace."""
    events = spark.readStream.schema(EVENTS).json(source)
    known = events.where(F.col("event").isin(*KINDS) & F.col("trace_id").isNotNull())
    return known.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
