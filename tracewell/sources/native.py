"""Recorded runs in their own JSON format: an object of artifacts, steps, claims, entries and assumptions.

Every malformed shape is an error that names what is wrong, never a null. Parsing is Python's, since JSON readers that
guess would turn bad runs into thin ones.
"""

from __future__ import annotations

import json
from typing import Any


class Malformed(ValueError):
    """A document that is no run, and why."""


def parse(raw: bytes) -> Any:
    """The JSON value of a UTF-8 document (a byte order mark is allowed)."""
    try:
        value = json.loads(raw.decode("utf-8-sig"))
    except UnicodeDecodeError as e:
        raise Malformed(f"not UTF-8: {e.reason} at byte {e.start}") from None
    except RecursionError:
        raise Malformed("nested too deeply") from None
    except ValueError as e:
        raise Malformed(f"not JSON: {e}") from None
    try:
        json.dumps(value, ensure_ascii=False).encode("utf-8")
    except UnicodeEncodeError:
        raise Malformed("holds a lone surrogate, which no text column can keep") from None
    except RecursionError:
        raise Malformed("nested too deeply") from None
    return value


def _need(value: Any, kind: type | tuple, where: str) -> Any:
    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
        names = {dict: "an object", list: "a list", str: "a string", int: "a whole number"}
        raise Malformed(f"{where} must be {names[kind]}, not {type(value).__name__}")
    return value


def _objects(data: dict, key: str) -> list[dict]:
    return [_need(x, dict, f"{key}[{k}]") for k, x in enumerate(_need(data.get(key, []), list, key))]


def _field(x: dict, key: str, where: str, kind: type = str) -> Any:
    if key not in x:
        raise Malformed(f"{where} has no {key}")
    return _need(x[key], kind, f"{where}.{key}")


def _names(x: dict, key: str, where: str) -> list[str]:
    return [_need(v, str, f"{where}.{key}[{k}]") for k, v in enumerate(_need(x.get(key, []), list, f"{where}.{key}"))]


KINDS = ("document", "tool_result", "intermediate", "final_answer")
ACCOUNTS = ("EVIDENCE", "PRIOR", "ASSUMPTION")


def _account(text: str, where: str) -> str:
    kind, _, rest = text.partition(":")
    if kind not in ACCOUNTS:
        raise Malformed(f"{where} is no account: {text!r}")
    if kind == "EVIDENCE":
        name, _, span = rest.rpartition("#")
        lo, dash, hi = span.partition("-")
        if not (name and "#" not in name and dash and lo.isdigit() and hi.isdigit()):
            raise Malformed(f"{where} cites no span: {text!r}")
    elif not rest:
        raise Malformed(f"{where} has no label: {text!r}")
    return text


def rows(data: Any) -> dict[str, list[dict]]:
    """The rows of the five tables, without run_id."""
    _need(data, dict, "a run")
    if not {"artifacts", "steps"} & data.keys():
        raise Malformed("a run has artifacts or steps")
    out: dict[str, list[dict]] = {k: [] for k in ("artifacts", "steps", "claims", "entries", "assumptions")}
    content: dict[str, str] = {}
    for k, x in enumerate(_objects(data, "artifacts")):
        where = f"artifacts[{k}]"
        name, kind = _field(x, "artifact_id", where), _field(x, "kind", where)
        if kind not in KINDS:
            raise Malformed(f"{where}.kind is none of {', '.join(KINDS)}: {kind!r}")
        if name in content:
            raise Malformed(f"artifact {name!r} is given twice")
        content[name] = _field(x, "content", where)
        out["artifacts"].append({"artifact_id": name, "kind": kind, "content": content[name], "title": str(x.get("title", "")), "ord": k})
    for k, x in enumerate(_objects(data, "steps")):
        where = f"steps[{k}]"
        out["steps"].append({"step_id": _field(x, "step_id", where), "kind": str(x.get("kind", "generate")), "inputs": _names(x, "inputs", where), "outputs": _names(x, "outputs", where), "ord": k})
    for k, x in enumerate(_objects(data, "claims")):
        where = f"claims[{k}]"
        lo, hi, art = _field(x, "start", where, int), _field(x, "end", where, int), _field(x, "artifact_id", where)
        out["claims"].append({"claim_id": _field(x, "claim_id", where), "artifact_id": art, "start": lo, "end": hi, "text": _need(x.get("text", ""), str, f"{where}.text") or content.get(art, "")[max(lo, 0) : max(hi, 0)], "ord": k})
    for k, x in enumerate(_objects(data, "entries")):
        where = f"entries[{k}]"
        account = _account(_field(x, "account", where), f"{where}.account")
        out["entries"].append({"entry_id": _field(x, "entry_id", where), "claim_id": _field(x, "claim_id", where), "account": account, "quoted_span": str(x.get("quoted_span", "")), "proposed_by": str(x.get("proposed_by", "manual")), "grp": str(x.get("group", "") or ""), "ord": k})
    for name, text in _need(data.get("assumptions", {}), dict, "assumptions").items():
        out["assumptions"].append({"id": name, "text": _need(text, str, f"assumptions[{name!r}]")})
    return out


def to_json(parts: dict[str, list[dict]]) -> dict:
    """The document of a run's rows: the inverse of rows()."""
    plain = lambda x, *drop: {k: v for k, v in x.items() if k not in ("ord", "run_id", *drop)}
    return {
        "artifacts": [plain(x) for x in parts["artifacts"]],
        "steps": [plain(x) for x in parts["steps"]],
        "claims": [plain(x) for x in parts["claims"]],
        "entries": [plain(x, "grp") | ({"group": x["grp"]} if x["grp"] else {}) for x in parts["entries"]],
        "assumptions": {x["id"]: x["text"] for x in parts["assumptions"]},
    }
