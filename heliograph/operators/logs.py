"""Log operators: selection, token search, keyset pages, exact counts, tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.filters import Document, compile_filter

MAX_PAGE = 1000
RETAINED = 100_000
DAY_NS = 86_400 * 1_000_000_000


def document() -> Document:
    c = F.col
    strings = ("project", "environment", "service", "severity", "body", "trace_id", "event_id")
    return Document({n: ("string", c(n)) for n in strings} | {"cursor": ("long", c("cursor")), "occurred_ns": ("long", c("occurred_ns")), "value": ("double", c("value"))}, json={"payload": c("payload")})


def select(logs: DataFrame, project: str, *, environment: str | None = None, service: str | None = None, severity: str | None = None, trace_id: str | None = None, span_id: str | None = None, request_id: str | None = None, session_id: str | None = None, resource_type: str | None = None, attributes: dict[str, str] | None = None, start: int | None = None, stop: int | None = None, after: int | None = None) -> DataFrame:
    """Logs of a project; start <= time < stop in nanoseconds; severity without regard to ASCII case.

    request.id, session.id and resource.type are looked up in the attributes map,
    as is every entry of `attributes`; the columns are read only where asked for.
    """
    if not project.strip():
        raise ValueError("a project is required")
    tests: list[Column] = [F.col("project") == project]
    for name, value in (("environment", environment), ("service", service), ("trace_id", trace_id), ("span_id", span_id)):
        if value is not None:
            tests.append(F.col(name) == value)
    ids = {"request.id": request_id, "session.id": session_id, "resource.type": resource_type}
    for name, value in ((attributes or {}) | {k: v for k, v in ids.items() if v is not None}).items():
        tests.append(F.try_element_at("attributes", F.lit(name)) == value)
    if severity is not None:
        tests.append(F.upper("severity") == severity.upper())
    if start is not None:
        tests.append(F.col("occurred_ns") >= start)
    if stop is not None:
        tests.append(F.col("occurred_ns") < stop)
    if after is not None:
        tests.append(F.col("cursor") > after)
    for t in tests:
        logs = logs.where(t)
    return logs


def match_all(logs: DataFrame, text: str, column: str = "body") -> DataFrame:
    """Logs whose lower-cased white-space tokens hold all tokens of the text."""
    wanted = F.array(*map(F.lit, dict.fromkeys(text.lower().split()))) if text.split() else F.array().cast("array<string>")
    return logs.where(F.size(F.array_except(wanted, F.split(F.lower(column), r"(?U)\s+"))) == 0)


def page(logs: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    """The next `limit` rows by cursor and whether there are more (`has_more`)."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError("limit is 1 to 1000")
    some = (logs if after is None else logs.where(F.col("cursor") > after)).orderBy("cursor").limit(limit + 1)
    # The windows run over the page's limit + 1 rows at most, never over the table.
    numbered = some.withColumn("_k", F.row_number().over(Window.orderBy("cursor"))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("_k") <= limit).drop("_k")


def strict_page(logs: DataFrame, limit: int, tree: dict | None, after: int | None = None) -> DataFrame:
    """A page first, then the filter over it: it may hold fewer rows, even none, and still have more behind it."""
    out = page(logs, limit, after)
    return out if tree is None else out.where(compile_filter(tree, document()))


def count(logs: DataFrame, start: int, stop: int, tree: dict | None = None) -> DataFrame:
    """Exact number of logs in a window of at most 24 hours."""
    if not 0 < stop - start <= DAY_NS:
        raise ValueError("the window is longer than nothing and at most 24 hours")
    some = logs.where((F.col("occurred_ns") >= start) & (F.col("occurred_ns") < stop))
    if tree is not None:
        some = some.where(compile_filter(tree, document()))
    return some.agg(F.count("*").alias("n"))


def retained(logs: DataFrame, most: int = RETAINED) -> DataFrame:
    """The newest rows: a top-k by cursor, which is the feature."""
    return logs.orderBy(F.col("cursor").desc()).limit(most)
