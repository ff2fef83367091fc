"""Posting: claims located in model text, and entries that credit them to what the writing step was given.

A proposer is any callable (task, payload) -> answer: task "segment" with a text gives claim texts, task "credit" with
a claim and its sources gives (artifact_id, quote) pairs. It is asked on the executors, a run at a time; no model is
part of this library.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.locate import Span, outside, to_claims, tolerant
from tracewell.functions.sentences import sentences
from tracewell.plans.model import Runs, by_run, step_inputs, step_outputs
from tracewell.sources import native
from tracewell.sources.files import TABLES, to_documents

Proposer = Callable[[str, dict], list]
#: A final answer that is a bare value is posted whole: one line of so many characters and words.
BARE_CHARS, BARE_WORDS = 24, 4


def verbatim(task: str, payload: dict) -> list:
    """A proposer without a model: sentences are claims, and no credits but the self-evident ones."""
    return [payload["text"][a:b] for a, b in sentences(payload["text"])] if task == "segment" else []


DROPPED = "run_id string, claim_id string, artifact_id string, quote string, reason string, proposed_by string"


@dataclass
class Log:
    """What a proposer offered that was not posted, and what else was amiss."""

    dropped: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def drop(self, claim_id: str, artifact_id: str, quote: str, reason: str, who: str) -> None:
        self.dropped.append({"claim_id": claim_id, "artifact_id": artifact_id, "quote": quote, "reason": reason, "proposed_by": who})


def ask(proposer: Proposer, task: str, payload: dict, log: Log, tries: int = 2) -> list:
    """A proposer's answer; what is no list is asked for once more, and then counts as none."""
    for k in range(tries):
        answer = proposer(task, payload)
        if isinstance(answer, list):
            return answer
        log.warnings.append(f"{task}: {type(answer).__name__} instead of a list" + (", asked again" if k + 1 < tries else ""))
    return []


def fence(texts: list[str], mark: str = "<", least: int = 3) -> str:
    """Marks to set texts apart in a prompt: more in a row than any of them holds."""
    return mark * max([least, *(len(run) + 1 for t in texts for run in re.findall(f"{re.escape(mark)}+", t))])


def scripted(answers: dict[str, dict[str, list]]) -> Proposer:
    """A proposer that gives prepared answers: by task, then by the text or the claim that it is asked about; none for
    what it was not prepared for."""
    return lambda task, payload: answers.get(task, {}).get(payload.get("text", payload.get("claim", "")), [])


def self_evident(runs: Runs) -> DataFrame:
    """(run_id, claim_id, artifact_id, start): claims whose text stands word for word in an input of their step."""
    given = step_outputs(runs.steps).select("run_id", F.col("artifact_id").alias("own"), "step_id").join(step_inputs(runs.steps), ["run_id", "step_id"])
    claims = runs.claims.select("run_id", "claim_id", F.col("artifact_id").alias("own"), "text")
    sources = runs.artifacts.select("run_id", "artifact_id", "content")
    met = claims.join(given, ["run_id", "own"]).join(sources, ["run_id", "artifact_id"]).where(F.contains("content", "text"))
    return met.select("run_id", "claim_id", "artifact_id", (F.instr("content", F.col("text")) - 1).alias("start"))


def segment(artifact: dict, proposer: Proposer, log: Log | None = None) -> list[dict]:
    """The claims of an artifact in the order of its text. Sentences of intermediate text that the proposer left out
    are claims too; a bare answer without a claim is one."""
    text, found, log = artifact["content"], {}, log or Log()
    for said in ask(proposer, "segment", {"artifact_id": artifact["artifact_id"], "text": text}, log):
        if span := tolerant(text, str(said), list(found)):
            found[span] = "proposer"
        else:
            log.drop("", artifact["artifact_id"], str(said), "claim text is not found verbatim", "proposer")
    if artifact["kind"] == "intermediate":
        for a, b in sentences(text):
            if not any(x < b and a < y for x, y in found):
                found[a, b] = "coverage"
    bare = text.strip()
    if artifact["kind"] == "final_answer" and not found and 0 < len(bare) <= BARE_CHARS and len(bare.split()) <= BARE_WORDS and "\n" not in bare:
        at = text.index(bare)
        found[at, at + len(bare)] = "whole-answer"
    return [{"claim_id": f"{artifact['artifact_id']}.c{k}", "artifact_id": artifact["artifact_id"], "start": a, "end": b, "text": text[a:b], "proposed_by": found[a, b]} for k, (a, b) in enumerate(sorted(found), 1)]


def credit(claim: dict, sources: list[dict], spans: dict[str, list[Span]], proposer: Proposer, log: Log | None = None) -> list[dict]:
    """The entries of a claim: self-evident credits, then the proposer's; PRIOR:model if there is none."""
    by_id, log, own = {s["artifact_id"]: s for s in sources}, log or Log(), claim["claim_id"]
    asked = [("verbatim", s["artifact_id"], claim["text"]) for s in sources if tolerant(s["content"], claim["text"])]
    for c in ask(proposer, "credit", {"claim": claim["text"], "sources": sources}, log):
        if isinstance(c, (list, tuple)) and len(c) == 2:
            asked.append(("proposer", *map(str, c)))
        else:
            log.drop(own, "", str(c), "credit is not a pair", "proposer")
    out: list[dict] = []
    seen: set[tuple] = set()
    for who, name, quote in asked:
        source = by_id.get(name)
        span = source and tolerant(source["content"], quote)
        if not span:
            log.drop(own, name, quote, "quote is not found verbatim in the artifact" if source else "artifact is not among the step's inputs", who)
            continue
        kept = [span]
        if source["kind"] not in ("document", "tool_result"):
            kept, refused = to_claims(source["content"], span, spans.get(name, []))
            for a, b in refused:
                log.drop(own, name, quote, f"quote only partially overlaps claim {name}#{a}-{b}", who)
            if not kept:
                log.drop(own, name, quote, "quote covers no whole claim of the artifact", who)
                continue
            if beyond := outside(source["content"], span, kept):
                log.warnings.append(f"{own}: {beyond} characters of a quote of {name} lie outside any claim")
        if (name, tuple(kept)) in seen:
            continue
        seen.add((name, tuple(kept)))
        group = f"{claim['claim_id']}.g{len(out) + 1}" if len(kept) > 1 else ""
        for a, b in kept:
            out.append({"entry_id": f"{claim['claim_id']}.e{len(out) + 1}", "claim_id": claim["claim_id"], "account": f"EVIDENCE:{name}#{a}-{b}", "quoted_span": source["content"][a:b], "proposed_by": who, "group": group})
    return out or [{"entry_id": f"{claim['claim_id']}.e0", "claim_id": claim["claim_id"], "account": "PRIOR:model", "quoted_span": "", "proposed_by": "proposer", "group": ""}]


def post_document(run: dict, proposer: Proposer, on_demand: bool = False) -> dict:
    """A run with its claims and entries posted anew, and in `_proposal` what was not posted. With on_demand, only claims
    that a chain from the final answer reaches are credited."""
    log = Log()
    parts = native.rows(run)
    artifacts = {a["artifact_id"]: a for a in parts["artifacts"]}
    maker = {o: s for s in parts["steps"] for o in s["outputs"]}
    order = [artifacts[o] for s in parts["steps"] for o in s["outputs"] if o in artifacts]
    order += [a for a in artifacts.values() if a["artifact_id"] not in maker]
    derived = list({a["artifact_id"]: a for a in order if a["kind"] in ("intermediate", "final_answer")}.values())
    claims = {a["artifact_id"]: segment(a, proposer, log) for a in derived}
    spans = {k: [(c["start"], c["end"]) for c in v] for k, v in claims.items()}

    def entries_of(c: dict) -> list[dict]:
        given = maker.get(c["artifact_id"], {"inputs": []})["inputs"]
        return credit(c, [artifacts[i] for i in given if i in artifacts], spans, proposer, log)

    everything = [c for a in derived for c in claims[a["artifact_id"]]]
    entries: list[dict] = []
    if on_demand:
        queue, asked = deque(c for a in derived if a["kind"] == "final_answer" for c in claims[a["artifact_id"]]), set()
        while queue:
            c = queue.popleft()
            if c["claim_id"] in asked:
                continue
            asked.add(c["claim_id"])
            for e in entries_of(c):
                entries.append(e)
                if e["account"].startswith("EVIDENCE:"):
                    name, _, at = e["account"][9:].rpartition("#")
                    lo, hi = map(int, at.split("-"))
                    queue.extend(x for x in claims.get(name, []) if x["start"] < hi and lo < x["end"])
    else:
        entries = [e for c in everything for e in entries_of(c)]
    return native.to_json(parts | {"claims": [], "entries": []}) | {"claims": everything, "entries": entries, "_proposal": {"dropped_credits": log.dropped, "warnings": log.warnings}}


def post(runs: Runs, proposer: Proposer = verbatim, on_demand: bool = False) -> Runs:
    """Runs with claims and entries posted by the proposer."""
    return post_with_log(runs, proposer, on_demand)[0]


def post_with_log(runs: Runs, proposer: Proposer = verbatim, on_demand: bool = False) -> tuple[Runs, DataFrame, DataFrame]:
    """(runs with claims and entries posted by the proposer, DROPPED, warnings(run_id, warning)). A run is one row and is
    posted once, on an executor."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[Any, ...]] = []
            for name, text in zip(b["run_id"], b["json"], strict=True):
                document = post_document(json.loads(text), proposer, on_demand)
                parts = native.rows(document)
                out += [(name, k, json.dumps([x | {"run_id": name} for x in rows], ensure_ascii=False)) for k, rows in (("dropped", document["_proposal"]["dropped_credits"]), ("warnings", [{"warning": w} for w in document["_proposal"]["warnings"]])) if rows]
                out += [(name, k, json.dumps([x | {"run_id": name} for x in parts[k]], ensure_ascii=False)) for k in ("claims", "entries") if parts[k]]
            yield pd.DataFrame(out, columns=["run_id", "part", "payload"], dtype=object)

    posted = by_run(to_documents(runs).mapInPandas(work, "run_id string, part string, payload string"))
    schemas = TABLES | {"dropped": DROPPED, "warnings": "run_id string, warning string"}
    typed = lambda k: posted.where(F.col("part") == k).select(F.explode(F.from_json("payload", f"array<struct<{_ddl(schemas[k])}>>")).alias("x")).select("x.*")
    return Runs(runs.artifacts, runs.steps, typed("claims"), typed("entries"), runs.assumptions), typed("dropped"), typed("warnings")


def _ddl(schema: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in schema.split(", "))
