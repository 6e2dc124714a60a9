"""The filter language: a JSON tree of predicates over documents, compiled to one Column.

Leaves are two-valued: a missing field is false, so `not` of it is true.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.values import json_at, json_literal, json_text

MAX_DEPTH, MAX_ARGS, MAX_FIELD_BYTES, MAX_PATTERN_BYTES = 32, 64, 256, 1024
_BOUNDS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_SHAPES = {"and": {"args"}, "or": {"args"}, "not": {"arg"}, "eq": {"field", "value"}, "in": {"field", "values"}, "exists": {"field"}, "text": {"field", "value"}, "regex": {"field", "pattern"}}


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Document:
    """How fields resolve: fixed columns (name to type and column), maps of strings, and JSON columns."""

    columns: dict[str, tuple[str, Column]]
    maps: dict[str, Column] = field(default_factory=dict)
    json: dict[str, Column] = field(default_factory=dict)

    def find(self, name: str) -> tuple[str, Column]:
        """(type, column) of a field: the whole name, then first part and whole rest as one key, then the path."""
        if name in self.columns:
            return self.columns[name]
        if name in self.json:
            return "json", json_at(self.json[name], [])
        first, _, rest = name.partition(".")
        if rest and first in self.maps:
            return "string", F.try_element_at(self.maps[first], F.lit(rest))
        if rest and first in self.json:
            one, path = json_at(self.json[first], [rest]), json_at(self.json[first], rest.split("."))
            return "json", one if "." not in rest else F.coalesce(one, path)
        return "none", F.lit(None).cast("string")


def validate(tree: object, depth: int = 1) -> None:
    if depth > MAX_DEPTH:
        raise FilterError("filter is nested too deeply")
    if not isinstance(tree, dict) or not isinstance(tree.get("op"), str):
        raise FilterError("a filter is an object with an op")
    op, keys = tree["op"], set(tree) - {"op"}
    if op == "range":
        bounds = {k for k in _BOUNDS if tree.get(k) is not None}
        if not keys <= {"field", *_BOUNDS} or "field" not in keys or not bounds or {"gt", "gte"} <= bounds or {"lt", "lte"} <= bounds:
            raise FilterError("range needs a field and at most one lower and one upper bound, one of them at least")
    elif op not in _SHAPES or keys != _SHAPES[op]:
        raise FilterError(f"unknown or malformed operator {op!r}")
    if op in ("and", "or"):
        if not isinstance(tree["args"], list) or not 1 <= len(tree["args"]) <= MAX_ARGS:
            raise FilterError(f"{op} takes 1 to {MAX_ARGS} arguments")
        for arg in tree["args"]:
            validate(arg, depth + 1)
        return
    if op == "not":
        return validate(tree["arg"], depth + 1)
    if not isinstance(tree["field"], str) or not 1 <= len(tree["field"].encode()) <= MAX_FIELD_BYTES:
        raise FilterError("field names have 1 to 256 bytes")
    if op == "in" and not (isinstance(tree["values"], list) and 1 <= len(tree["values"]) <= MAX_ARGS):
        raise FilterError(f"in takes 1 to {MAX_ARGS} values")
    if op == "text" and not isinstance(tree["value"], str):
        raise FilterError("text takes a string")
    if op == "regex":
        java_pattern(tree["pattern"])


def java_pattern(pattern: object) -> str:
    """A pattern in Java's form: Unicode classes; look-around and back references are refused."""
    if not isinstance(pattern, str) or len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise FilterError("a pattern is a string of at most 1024 bytes")
    if re.search(r"\(\?<?[=!]|(?<!\\)(?:\\\\)*\\[1-9]|\\k<", pattern):
        raise FilterError("look-around and back references are not supported")
    try:
        re.compile(re.sub(r"\\p\{\w+\}|\\P\{\w+\}|\\[zAG]", "x", pattern.replace("(?<", "(?P<")))
    except re.error as e:
        raise FilterError(f"invalid pattern: {e}") from e
    return f"(?U){pattern}"


def _equal(kind: str, column: Column, value: object) -> Column:
    if kind == "json":
        return column == json_literal(value)
    fits = {"string": isinstance(value, str), "long": isinstance(value, int) and not isinstance(value, bool), "double": isinstance(value, float), "bool": isinstance(value, bool)}
    return column == F.lit(value) if fits.get(kind) else F.lit(False)


def _text(kind: str, column: Column) -> Column:
    return json_text(column) if kind == "json" else column.cast("string")


def _compare(kind: str, column: Column, bound: object, test: Callable) -> Column:
    number = isinstance(bound, (int, float)) and not isinstance(bound, bool)
    if kind == "json":
        if number:
            return column.rlike(r"^-?[0-9]") & test(column.try_cast("double"), F.lit(float(bound)))
        return column.startswith('"') & test(json_text(column), F.lit(bound)) if isinstance(bound, str) else F.lit(False)
    if kind in ("long", "double") and number:
        return test(column.cast("double"), F.lit(float(bound)))
    return test(column, F.lit(bound)) if kind == "string" and isinstance(bound, str) else F.lit(False)


def compile_filter(tree: dict, document: Document, *, check: bool = True) -> Column:
    """One Boolean column, never null, for a filter tree."""
    if check:
        validate(tree)
    op = tree["op"]
    if op in ("and", "or"):
        return functools.reduce(operator.and_ if op == "and" else operator.or_, (compile_filter(a, document, check=False) for a in tree["args"]))
    if op == "not":
        return ~compile_filter(tree["arg"], document, check=False)
    kind, column = document.find(tree["field"])
    if op == "eq":
        out = _equal(kind, column, tree["value"])
    elif op == "in":
        out = functools.reduce(operator.or_, (F.coalesce(_equal(kind, column, v), F.lit(False)) for v in tree["values"]))
    elif op == "exists":
        out = column.isNotNull() & (column != "null") if kind == "json" else column.isNotNull()
    elif op == "range":
        out = functools.reduce(operator.and_, (_compare(kind, column, tree[k], test) for k, test in _BOUNDS.items() if tree.get(k) is not None))
    elif op == "text":
        out = F.lower(_text(kind, column)).contains(tree["value"].lower())
    else:
        out = _text(kind, column).rlike(java_pattern(tree["pattern"]))
    return F.coalesce(out, F.lit(False))
