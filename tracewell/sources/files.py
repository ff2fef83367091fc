"""Files of recorded runs, whatever their format, as the five tables; what can't be read becomes a row of errors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.plans.model import ARTIFACTS, ASSUMPTIONS, CLAIMS, ENTRIES, STEPS, Runs, by_run
from tracewell.sources import chat, native, spans, trajectory

NOTES = "run_id string, note string, artifact_id string, detail string"
#: Notes of native traces that must be lists of texts.
LISTED = ("truncated", "skipped_empty", "unmatched", "uncertain", "handed_back", "undeclared")
TABLES = {"artifacts": ARTIFACTS, "steps": STEPS, "claims": CLAIMS, "entries": ENTRIES, "assumptions": ASSUMPTIONS}
FORMATS = ("native", "otel", "openai", "trajectory")


def detect(data: Any) -> str:
    """The format of a document; two that fit, or none, are an error. Trajectories must be asked for."""
    fits = []
    if isinstance(data, dict) and {"artifacts", "steps"} & data.keys():
        fits.append("native")
    if spans.looks_like(data):
        fits.append("otel")
    if chat.messages_of(data) is not None:
        fits.append("openai")
    if len(fits) != 1:
        raise native.Malformed("the format is ambiguous: " + " or ".join(fits) if fits else "no known format")
    return fits[0]


def note_row(run_id: str, note: str, value: Any) -> dict[str, Any]:
    """What a reader notes of an artifact; more than its id is a JSON object."""
    if isinstance(value, dict):
        return {"run_id": run_id, "note": note, "artifact_id": str(value.get("artifact_id", "")), "detail": json.dumps(value)}
    return {"run_id": run_id, "note": note, "artifact_id": str(value), "detail": None}


def read_document(raw: bytes, form: str | None = None, **options: Any) -> tuple[dict[str, list[dict]], dict]:
    """(rows of the five tables, the reader's notes) of a document."""
    data = native.parse(raw)
    form = form or detect(data)
    if form == "native":
        made = data
    elif form == "trajectory":
        made = trajectory.to_run(data)
    else:
        made = (spans if form == "otel" else chat).to_run(data, **options)
    notes = made.get("_meta") if isinstance(made, dict) else None
    notes = notes if isinstance(notes, dict) else {}
    for k in LISTED:
        if form == "native" and k in notes and not (isinstance(notes[k], list) and all(isinstance(i, str) for i in notes[k])):
            raise native.Malformed(f"_meta.{k} is no list of texts")
    return native.rows(made), notes


def read_runs(spark: SparkSession, path: str, form: str | None = None, **options: Any) -> tuple[Runs, DataFrame, DataFrame]:
    """documents_as_runs() of the files under a path. A file is a run; its path is the run_id. Files are read by Spark,
    so any store that it knows will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return documents_as_runs(files.select("path", "content"), form, **options)


def documents_as_runs(documents: DataFrame, form: str | None = None, **options: Any) -> tuple[Runs, DataFrame, DataFrame]:
    """(runs, bad_runs(run_id, error), notes(run_id, note, artifact_id, detail)) of documents(path, content binary).

    Each is parsed once, on an executor; the tables are typed from the parsed parts by explicit schemas.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, raw in zip(b["path"], b["content"], strict=True):
                try:
                    parts, notes = read_document(bytes(raw), form, **options)
                except native.Malformed as e:
                    out.append((name, "error", json.dumps([str(e)])))
                    continue
                out += [(name, k, json.dumps([x | {"run_id": name} for x in v], ensure_ascii=False)) for k, v in parts.items() if v]
                listed = [note_row(name, k, i) for k, v in notes.items() if isinstance(v, list) for i in v]
                out.append((name, "notes", json.dumps(listed, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["run_id", "part", "payload"], dtype=object)

    parsed = by_run(documents.select("path", "content").mapInPandas(parse, "run_id string, part string, payload string"))

    def typed(part: str, schema: str) -> DataFrame:
        row = T.ArrayType(T.StructType.fromDDL(schema))
        return parsed.where(F.col("part") == part).select("run_id", F.explode(F.from_json("payload", row)).alias("x")).select("run_id", *(f"x.{f.name}" for f in row.elementType.fields if f.name != "run_id"))

    errors = parsed.where("part = 'error'").select("run_id", F.get(F.from_json("payload", T.ArrayType(T.StringType())), 0).alias("error"))
    runs = Runs(*(typed(k, TABLES[k]) for k in ("artifacts", "steps", "claims", "entries", "assumptions")))
    return runs, errors, typed("notes", NOTES)


def without(runs: Runs, bad: DataFrame) -> Runs:
    """The runs that have no error."""
    gone = bad.select("run_id").distinct()
    return Runs(*(t.join(gone, "run_id", "left_anti") for t in (runs.artifacts, runs.steps, runs.claims, runs.entries, runs.assumptions)))


def write_runs(runs: Runs, path: str) -> None:
    """The five tables as Parquet, each under its name."""
    for name in TABLES:
        getattr(runs, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def load_runs(spark: SparkSession, path: str) -> Runs:
    return Runs(*(spark.read.schema(TABLES[k]).parquet(f"{path}/{k}") for k in ("artifacts", "steps", "claims", "entries", "assumptions")))


def to_documents(runs: Runs) -> DataFrame:
    """(run_id, json): each run as one document of its own format."""
    out = runs.run_ids()
    for name in TABLES:
        t = getattr(runs, name)
        cols = [c for c in t.columns if c != "run_id"]
        order = ["ord"] if "ord" in cols else ["id"]
        packed = t.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in cols if c not in order)))).alias(name))
        out = out.join(packed, "run_id", "left")
    named = lambda x: F.map_from_entries(F.transform(F.coalesce(x, F.array().cast("array<struct<id:string,text:string>>")), lambda a: F.struct(a["id"], a["text"])))
    return out.select("run_id", F.to_json(F.struct(*(F.col(c) for c in ("artifacts", "steps", "claims", "entries")), named(F.col("assumptions")).alias("assumptions"))).alias("json"))
