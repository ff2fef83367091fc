"""Small runs with known verdicts."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.model import ARTIFACTS, ASSUMPTIONS, CLAIMS, ENTRIES, MAX_DEPTH, STEPS, Runs


def build(spark: SparkSession, runs: Iterable[dict]) -> Runs:
    """Runs from plain descriptions: artifacts (id, kind, content), steps (id, kind, inputs, outputs), claims (id,
    artifact, start, end), entries (id, claim, account, quote[, group]), assumptions {id: text}."""
    a, s, c, e, u = [], [], [], [], []
    for r in runs:
        name = r["run_id"]
        content = {i: t for i, _, t in r["artifacts"]}
        a += [(name, i, kind, t, "", k) for k, (i, kind, t) in enumerate(r["artifacts"])]
        s += [(name, i, kind, list(x), list(y), k) for k, (i, kind, x, y) in enumerate(r["steps"])]
        c += [(name, i, art, lo, hi, content.get(art, "")[lo:hi], k) for k, (i, art, lo, hi) in enumerate(r["claims"])]
        e += [(name, i, claim, acct, quote, "manual", (rest or [""])[0], k) for k, (i, claim, acct, quote, *rest) in enumerate(r["entries"])]
        u += [(name, i, t) for i, t in r.get("assumptions", {}).items()]
    return Runs(*(spark.createDataFrame(rows, schema) for rows, schema in ((a, ARTIFACTS), (s, STEPS), (c, CLAIMS), (e, ENTRIES), (u, ASSUMPTIONS))))


def laundered(spark: SparkSession) -> Runs:
    """A search result and a tool's figure, a summary with one invented sentence, and an answer that repeats it."""
    page = "The bridge was opened in 1932. It carries eight lanes of traffic."
    figure = "daily crossings: 160,000"
    parts = ["The bridge was opened in 1932.", "It was designed by a local engineer."]
    summary = " ".join(parts)
    answer = " ".join([*parts, "Some 160,000 cross it daily."])
    n = len(parts[0]) + 1
    m = len(summary) + 1
    at = figure.index("160,000")
    return build(spark, [{
        "run_id": "laundered",
        "artifacts": [("page", "document", page), ("figure", "tool_result", figure), ("summary", "intermediate", summary), ("answer", "final_answer", answer)],
        "steps": [("s1", "retrieve", [], ["page"]), ("s2", "tool", [], ["figure"]), ("s3", "summarize", ["page"], ["summary"]), ("s4", "answer", ["summary", "figure"], ["answer"])],
        "claims": [("summary.c1", "summary", 0, n - 1), ("summary.c2", "summary", n, len(summary)), ("answer.c1", "answer", 0, n - 1), ("answer.c2", "answer", n, m - 1), ("answer.c3", "answer", m, len(answer))],
        "entries": [
            ("e1", "summary.c1", f"EVIDENCE:page#0-{n - 1}", parts[0]), ("e2", "summary.c2", "PRIOR:model", ""),
            ("e3", "answer.c1", f"EVIDENCE:summary#0-{n - 1}", parts[0]), ("e4", "answer.c2", f"EVIDENCE:summary#{n}-{len(summary)}", parts[1]),
            ("e5", "answer.c3", f"EVIDENCE:figure#{at}-{len(figure)}", "160,000"),
        ],
    }])


def _chain(name: str, hops: int, ring: bool, grounded: bool) -> dict:
    """`hops` derived artifacts, each citing the one before; the first cites a document, the last one, or nothing."""
    text = "AAAA"
    ids = [f"d{k:04}" for k in range(hops)]
    source = lambda k: "doc" if k == 0 and grounded else ids[k - 1] if k or ring else None
    feeds = [[x for x in dict.fromkeys((source(k), ids[-1] if ring and k == 0 else None)) if x] for k in range(hops)]
    entries = [(f"e{k}", f"c{k:04}", f"EVIDENCE:{x}#0-4", text) for k in range(hops) if (x := source(k))]
    if ring and grounded:
        entries.append(("er", "c0000", f"EVIDENCE:{ids[-1]}#0-4", text))
    return {
        "run_id": name,
        "artifacts": [("doc", "document", text), *((i, "final_answer" if k == hops - 1 else "intermediate", text) for k, i in enumerate(ids))],
        "steps": [("s", "retrieve", [], ["doc"]), *((f"s{k}", "generate", feeds[k], [i]) for k, i in enumerate(ids))],
        "claims": [(f"c{k:04}", i, 0, 4) for k, i in enumerate(ids)],
        "entries": entries,
    }


def deep_and_cyclic(spark: SparkSession) -> Runs:
    return build(spark, [_chain("at the limit", MAX_DEPTH + 1, False, True), _chain("too deep", MAX_DEPTH + 3, False, True), _chain("ring with a way out", 20, True, True), _chain("closed ring", 5, True, False), _chain("nothing behind", 3, False, False)])


def documents(spark: SparkSession, **logs: object) -> DataFrame:
    """(path, content) of logs by name."""
    return spark.createDataFrame([(name, bytearray(json.dumps(log).encode())) for name, log in logs.items()], "path string, content binary")


def chat_tools(spark: SparkSession) -> DataFrame:
    """A chat whose tools reply with a page, with the note that they were given, and with that note among other words."""
    note = "The ferry crosses the strait four times a day"
    call = lambda i, name, **given: {"role": "assistant", "content": None, "tool_calls": [{"id": i, "function": {"name": name, "arguments": json.dumps(given)}}]}
    reply = lambda i, content: {"role": "tool", "tool_call_id": i, "content": content}
    log = [
        {"role": "user", "content": "How often does the ferry cross?"}, call("1", "search", q="ferry timetable"), reply("1", "Departures at six, ten, two and six from the north pier."),
        call("2", "save", note=note), reply("2", note), call("3", "save", note=note), reply("3", f"Stored today {note} it says\nfine"), {"role": "assistant", "content": f"{note}."},
    ]
    return documents(spark, chat=log)


def otel(spark: SparkSession) -> DataFrame:
    """Two spans in reverse order, the second of which repeats the first one's turns; and a tool's span."""
    part = lambda role, text: {"role": role, "parts": [{"type": "text", "content": text}]}
    attribute = lambda key, messages: {"key": f"gen_ai.{key}.messages", "value": {"stringValue": json.dumps(messages)}}
    asked, looked, said = part("user", "How often does the ferry cross?"), part("assistant", "I will look that up."), part("assistant", "Four times a day.")
    found = [{"key": "gen_ai.operation.name", "value": {"stringValue": "execute_tool"}}, {"key": "gen_ai.tool.name", "value": {"stringValue": "search"}}, {"key": "gen_ai.tool.call.result", "value": {"stringValue": "Departures at six, ten, two and six."}}]
    spans = [
        {"name": "chat", "startTimeUnixNano": "30", "attributes": [attribute("input", [asked, looked]), attribute("output", [said])]},
        {"name": "chat", "startTimeUnixNano": "10", "attributes": [attribute("input", [asked]), attribute("output", [looked])]}, {"name": "execute_tool search", "startTimeUnixNano": "20", "attributes": found},
    ]
    return documents(spark, export={"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})
