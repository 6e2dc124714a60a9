"""Column helpers: typed JSON values, floats that never raise, number text, canonical maps."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 1_000_000_000


def json_at(document: Column, keys: list[str]) -> Column:
    """The canonical JSON text of the value under a path of object keys; null where there is none."""
    path = "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)
    return F.to_json(F.try_variant_get(F.try_parse_json(document), path, "variant"))


def json_literal(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_text(value: Column) -> Column:
    """Text of a JSON scalar: strings unquoted, numbers and booleans as written, null for the rest."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).when(~value.rlike(r"^[\[{]") & (value != "null"), value)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: signed infinities and NaN instead of errors or nulls."""
    sign = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), F.lit(float("nan")))
    negative = (a < 0) != F.coalesce(F.try_divide(F.lit(1.0), F.when(b == 0, F.lit(None).cast("double")).otherwise(b)) < 0, F.lit(False))
    return F.when(b != 0, F.try_divide(a, b)).otherwise(sign.otherwise(F.when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))


def min_value(c: Column) -> Column:
    """Minimum that ignores NaN unless there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(c), c)), F.min(c))


def max_value(c: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))


def plain_number(c: Column) -> Column:
    """Shortest plain decimal text: 9, 0.5, NaN, +Inf, -Inf; no exponent."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(F.when(c.cast("string").contains("E"), text).otherwise(c.cast("string")))
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").otherwise(plain)


def identity(m: Column) -> Column:
    """A map as text with its keys in order: group and join keys must not be raw maps."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.to_json(F.array(e["key"], e["value"])))), ",")


def floor_to(t: Column, width: int) -> Column:
    """Start of the window of `width` that holds an integer time, also before zero."""
    return t - F.pmod(t, F.lit(width).cast("long"))
