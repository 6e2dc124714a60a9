"""Cross-signal operators: related logs, metrics and traces, and the service inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(*, trace_id: str | None = None, span_id: str | None = None, service: str | None = None, attributes: dict | None = None) -> None:
    if not any((trace_id, span_id, service, attributes)):
        raise ValueError("correlation needs a trace, span, service or attribute")


def series_with_exemplar(points: DataFrame, by: list[str], *, trace_id: str | None = None, span_id: str | None = None) -> DataFrame:
    """Series of which one exemplar has all given ids."""
    test = lambda e: (F.lit(True) if trace_id is None else e["trace_id"] == trace_id) & (F.lit(True) if span_id is None else e["span_id"] == span_id)
    return points.where(F.exists("exemplars", test)).select(*by).distinct()


def metrics_of_traces(points: DataFrame, traces: DataFrame, by: list[str]) -> DataFrame:
    """Series that have an exemplar in any of the traces."""
    each = points.select(*by, F.explode("exemplars").alias("e")).select(*by, F.col("e.trace_id").alias("trace_id")).distinct()
    return each.join(traces.select("trace_id").distinct(), "trace_id", "left_semi").select(*by).distinct()


def traces_with_span(spans: DataFrame, span_id: str) -> DataFrame:
    return spans.where(F.col("span_id") == span_id).select("project", "trace_id").distinct()


def services(*signals: tuple[str, DataFrame]) -> DataFrame:
    """service, environments, versions, signals: sorted, comma-joined, distinct; rows need service, environment and version."""
    rows = None
    for name, df in signals:
        part = df.select(F.coalesce("service", F.lit("unknown")).alias("service"), "environment", "version", F.lit(name).alias("signal")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("service").agg(text("environment").alias("environments"), text("version").alias("versions"), text("signal").alias("signals"))
