"""Verdicts of a model: strict parsing, and the schema that is asked for.

A verdict is used only if all of it is well formed. ``from_json`` is lenient where strictness matters (a
missing bound, a null list, text after the object), so a vectorised check decides and ``from_json`` reads
only what passed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

RANGE = "struct<from: bigint, to: bigint, axis: string, confidence: double, reason: string>"
VERDICT = f"delete_ranges array<{RANGE}>, protected array<{RANGE}>, need_context struct<before: bigint, after: bigint, why: string>, notes string"


def _object(properties: dict, required: list[str]) -> dict:
    return {"type": "object", "additionalProperties": False, "required": required, "properties": properties}


def verdict_schema(axes: tuple[str, ...]) -> dict:
    """The JSON schema that a provider is asked to keep to."""
    whole, text = {"type": "integer"}, {"type": "string"}
    span = {"from": whole, "to": whole, "reason": text}
    cut = _object({**span, "axis": {"type": "string", "enum": list(axes)}, "confidence": {"type": "number"}}, ["from", "to", "axis", "confidence", "reason"])
    need = _object({"before": whole, "after": whole, "why": text}, ["before", "after", "why"])
    lists = {"delete_ranges": {"type": "array", "items": cut}, "protected": {"type": "array", "items": _object(span, list(span))}}
    return _object({**lists, "need_context": {"anyOf": [need, {"type": "null"}]}, "notes": text}, [*lists, "need_context", "notes"])


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and -(1 << 63) <= x < 1 << 63


def _number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _fields(x: object, **checks) -> bool:
    """Fields that are there have the right type; others do not matter."""
    return isinstance(x, dict) and all(check(x[name]) for name, check in checks.items() if name in x)


def _text(x: object) -> bool:
    return isinstance(x, str)


def _range(x: object) -> bool:
    return isinstance(x, dict) and "from" in x and "to" in x and _fields(x, **{"from": _whole, "to": _whole, "axis": _text, "confidence": _number, "reason": _text})


def _ranges(x: object) -> bool:
    return isinstance(x, list) and all(map(_range, x))


def _need(x: object) -> bool:
    return x is None or _fields(x, before=_whole, after=_whole, why=_text)


#: Fields that may not occur twice in one object.
KNOWN = frozenset("from to axis confidence reason delete_ranges protected need_context notes before after why".split())


def _unique(pairs: list[tuple[str, object]]) -> dict:
    known = [k for k, _ in pairs if k in KNOWN]
    if len(known) > len(set(known)):
        raise ValueError("a field occurs twice")
    return dict(pairs)


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


def is_valid(raw: str | None) -> bool:
    try:
        found = json.loads(raw or "", object_pairs_hook=_unique, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return _fields(found, delete_ranges=_ranges, protected=_ranges, need_context=_need, notes=_text)


def valid(raw: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(is_valid).astype(bool), BooleanType())(raw)


def parsed(raw: Column, fine: Column) -> Column:
    """The verdict of texts that passed the check; absent lists are empty, absent texts are '' and numbers 0."""
    v = F.from_json(F.when(fine, raw), VERDICT)

    def filled(x: Column) -> Column:
        names = {"axis": "", "confidence": 0.0, "reason": ""}
        return F.struct(x["from"].alias("from"), x["to"].alias("to"), *(F.coalesce(x[n], F.lit(d)).alias(n) for n, d in names.items()))

    def listed(name: str) -> Column:
        return F.coalesce(F.transform(v[name], filled), F.from_json(F.lit("[]"), f"array<{RANGE}>")).alias(name)

    return F.when(fine, F.struct(listed("delete_ranges"), listed("protected"), v["need_context"].alias("need_context"), F.coalesce(v["notes"], F.lit("")).alias("notes")))
