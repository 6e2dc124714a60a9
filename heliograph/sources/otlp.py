"""OTLP/JSON envelopes to event rows, with reasons for the items that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY = "STRUCT<stringValue: STRING, boolValue: BOOLEAN, intValue: STRING, doubleValue: DOUBLE, bytesValue: STRING, arrayValue: STRING, kvlistValue: STRING>"
_ATTRS = f"ARRAY<STRUCT<key: STRING, value: {_ANY}>>"
_RESOURCE = f"STRUCT<attributes: {_ATTRS}>"
_SCOPE = f"STRUCT<name: STRING, version: STRING, attributes: {_ATTRS}>"
LOGS = f"resourceLogs ARRAY<STRUCT<resource: {_RESOURCE}, scopeLogs: ARRAY<STRUCT<scope: {_SCOPE}, logRecords: ARRAY<STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityText: STRING, severityNumber: INT, body: {_ANY}, attributes: {_ATTRS}, traceId: STRING, spanId: STRING>>>>>>"
_EXEMPLARS = "ARRAY<STRUCT<asDouble: DOUBLE, asInt: STRING, traceId: STRING, spanId: STRING>>"
_POINT = f"attributes: {_ATTRS}, startTimeUnixNano: STRING, timeUnixNano: STRING, flags: BIGINT, exemplars: {_EXEMPLARS}"
_NUMBERS = f"dataPoints: ARRAY<STRUCT<{_POINT}, asDouble: DOUBLE, asInt: STRING>>"
_BUCKETS = f"dataPoints: ARRAY<STRUCT<{_POINT}, count: STRING, sum: DOUBLE, min: DOUBLE, max: DOUBLE, bucketCounts: ARRAY<STRING>, explicitBounds: ARRAY<DOUBLE>, scale: INT, zeroCount: STRING, positive: STRUCT<offset: INT, bucketCounts: ARRAY<STRING>>, negative: STRUCT<offset: INT, bucketCounts: ARRAY<STRING>>>>, aggregationTemporality: STRING"
METRICS = f"resourceMetrics ARRAY<STRUCT<resource: {_RESOURCE}, scopeMetrics: ARRAY<STRUCT<scope: {_SCOPE}, metrics: ARRAY<STRUCT<name: STRING, unit: STRING, gauge: STRUCT<{_NUMBERS}>, sum: STRUCT<{_NUMBERS}, aggregationTemporality: STRING, isMonotonic: BOOLEAN>, histogram: STRUCT<{_BUCKETS}>, exponentialHistogram: STRUCT<{_BUCKETS}>>>>>>>"
TRACES = f"resourceSpans ARRAY<STRUCT<resource: {_RESOURCE}, scopeSpans: ARRAY<STRUCT<scope: {_SCOPE}, spans: ARRAY<STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: INT, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_ATTRS}, status: STRUCT<code: STRING, message: STRING>, links: ARRAY<STRUCT<traceId: STRING, spanId: STRING>>>>>>>>"


def any_text(v: Column) -> Column:
    """An AnyValue as text: scalars plain, arrays and maps as their JSON."""
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"])


def any_tagged(v: Column) -> Column:
    """An AnyValue as the JSON of its tagged form: equality of values is equality of this text."""
    tag = lambda kind, value: F.concat(F.lit(f'{{"type":"{kind}","value":'), value, F.lit("}"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return (
        F.when(v["stringValue"].isNotNull(), tag("string", quoted(v["stringValue"])))
        .when(v["boolValue"].isNotNull(), tag("bool", v["boolValue"].cast("string")))
        .when(v["intValue"].isNotNull(), tag("int", v["intValue"]))
        .when(v["doubleValue"].isNotNull(), tag("double", v["doubleValue"].cast("string")))
        .when(v["bytesValue"].isNotNull(), tag("bytes", quoted(v["bytesValue"])))
        .when(v["arrayValue"].isNotNull(), tag("array", v["arrayValue"]))
        .when(v["kvlistValue"].isNotNull(), tag("map", v["kvlistValue"]))
    )


def attributes(entries: Column, value=any_text) -> Column:
    """A map of attributes; of a repeated key the last value stays, entries without key or value go."""
    some = F.filter(F.coalesce(entries, F.array().cast(_ATTRS)), lambda e: e["key"].isNotNull() & value(e["value"]).isNotNull())
    keys = F.array_distinct(F.transform(some, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: value(F.element_at(F.filter(some, lambda e: e["key"] == k), -1)["value"])))


def resource(entries: Column) -> Column:
    out = attributes(entries)
    return F.when(F.size(out) == 0, F.create_map(F.lit("service.name"), F.lit("unknown"))).otherwise(out)


def environment(res: Column) -> Column:
    return F.coalesce(F.try_element_at(res, F.lit("deployment.environment.name")), F.try_element_at(res, F.lit("environment")), F.lit("default"))


def temporality(code: Column) -> Column:
    return F.when(code.isin("1", "AGGREGATION_TEMPORALITY_DELTA"), "delta").when(code.isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), "cumulative")


def _items(df: DataFrame, column: str, schema: str, outer: str, scopes: str, items: str, keep: list[str]) -> DataFrame:
    """One row an item.  An envelope that is no JSON object, and a part without scopes or items, is a row without an item."""
    root = df.select(*keep, F.from_json(column, schema).alias("root"))
    a = root.select(*keep, F.explode_outer(f"root.{outer}").alias("a"))
    # The resource is read once a part, before its scopes multiply.
    a = a.select(*keep, F.explode(F.array(resource(F.col("a.resource.attributes")))).alias("resource"), "a")
    b = a.select(*keep, "resource", F.explode_outer(f"a.{scopes}").alias("b"))
    return b.select(*keep, "resource", F.col("b.scope.name").alias("scope"), F.explode_outer(f"b.{items}").alias("item"))


EMPTY = "the envelope holds no items"


def logs(df: DataFrame, column: str = "envelope", *, project: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a log record; `error` where the body is missing or a time is no number."""
    i = F.col("item")
    t = i["timeUnixNano"].try_cast("long")
    observed = i["observedTimeUnixNano"].try_cast("long")
    occurred = F.when(F.coalesce(t, F.lit(0)) == 0, F.coalesce(observed, F.lit(0))).otherwise(t)
    attrs = attributes(i["attributes"])
    out = _items(df, column, LOGS, "resourceLogs", "scopeLogs", "logRecords", [*keep])
    return out.select(
        *keep, F.lit(project).alias("project"), environment(F.col("resource")).alias("environment"), "resource", "scope", occurred.alias("occurred_ns"), F.when(F.coalesce(observed, F.lit(0)) == 0, occurred).otherwise(observed).alias("observed_ns"),
        i["severityText"].alias("severity"), any_text(i["body"]).alias("body"), attrs.alias("attributes"), F.nullif(i["traceId"], F.lit("")).alias("trace_id"), F.nullif(i["spanId"], F.lit("")).alias("span_id"),
        F.when(i.isNull(), EMPTY).when(any_text(i["body"]).isNull(), "log record has no body").when(i["timeUnixNano"].isNotNull() & t.isNull(), "time is no number").alias("error"),
    )


def spans(df: DataFrame, column: str = "envelope", *, project: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a span; `error` where ids or name are missing, or it ends before it starts."""
    i = F.col("item")
    start, stop = i["startTimeUnixNano"].try_cast("long"), i["endTimeUnixNano"].try_cast("long")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    out = _items(df, column, TRACES, "resourceSpans", "scopeSpans", "spans", [*keep])
    return out.select(
        *keep, F.lit(project).alias("project"), environment(F.col("resource")).alias("environment"), "resource", "scope", i["traceId"].alias("trace_id"), i["spanId"].alias("span_id"), F.nullif(i["parentSpanId"], F.lit("")).alias("parent_id"),
        i["name"].alias("operation"), start.alias("start"), stop.alias("stop"), i["status"]["code"].alias("status"), attributes(i["attributes"]).alias("attributes"), i["links"].alias("links"),
        F.when(i.isNull(), EMPTY).when(blank(i["traceId"]) | blank(i["spanId"]) | blank(i["name"]), "span needs traceId, spanId and name").when(start.isNull() | stop.isNull() | (stop < start), "span times are invalid").alias("error"),
    )


def metrics(df: DataFrame, column: str = "envelope", *, project: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a data point of gauges, sums and both sorts of histograms."""
    from heliograph.operators.metrics import histogram_problem

    i = F.col("item")
    out = _items(df, column, METRICS, "resourceMetrics", "scopeMetrics", "metrics", [*keep])
    longs = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.try_cast("long"))
    exemplars = lambda p: F.filter(F.transform(F.coalesce(p["exemplars"], F.array().cast(_EXEMPLARS)), lambda e: F.struct(F.coalesce(e["asDouble"], e["asInt"].try_cast("double")).alias("value"), e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"))), lambda e: e["value"].isNotNull() & (e["trace_id"] != "") & (e["span_id"] != ""))
    none = F.lit(None)

    def point(p: Column, kind: str, tempo: Column, hist: bool) -> Column:
        value = p["sum"] if hist else F.coalesce(p["asDouble"], p["asInt"].try_cast("double"))
        return F.struct(
            F.lit(kind).alias("kind"), tempo.alias("temporality"), p["attributes"].alias("attributes"), p["startTimeUnixNano"].try_cast("long").alias("start_time"), p["timeUnixNano"].try_cast("long").alias("t"),
            (F.coalesce(p["flags"], F.lit(0)).bitwiseAND(1) == 1).alias("stale"), F.coalesce(value, F.lit(0.0) if hist else none.cast("double")).alias("value"), exemplars(p).alias("exemplars"),
            (p["count"].try_cast("long") if hist else none.cast("long")).alias("count"), (longs(p["bucketCounts"]) if hist else F.array().cast("array<bigint>")).alias("counts"), (F.coalesce(p["explicitBounds"], F.array().cast("array<double>")) if hist else F.array().cast("array<double>")).alias("bounds"),
            (p["min"] if hist else none.cast("double")).alias("min"), (p["max"] if hist else none.cast("double")).alias("max"), (p["scale"] if hist else none.cast("int")).alias("scale"), (p["zeroCount"].try_cast("long") if hist else none.cast("long")).alias("zero_count"),
            (longs(p["positive"]["bucketCounts"]) if hist else F.array().cast("array<bigint>")).alias("positive"), (longs(p["negative"]["bucketCounts"]) if hist else F.array().cast("array<bigint>")).alias("negative"),
        )

    points = F.flatten(F.filter(F.array(
        F.transform(i["gauge"]["dataPoints"], lambda p: point(p, "gauge", F.lit("gauge"), False)), F.transform(i["sum"]["dataPoints"], lambda p: point(p, "sum", temporality(i["sum"]["aggregationTemporality"]), False)),
        F.transform(i["histogram"]["dataPoints"], lambda p: point(p, "histogram", temporality(i["histogram"]["aggregationTemporality"]), True)), F.transform(i["exponentialHistogram"]["dataPoints"], lambda p: point(p, "exponential", temporality(i["exponentialHistogram"]["aggregationTemporality"]), True)),
    ), lambda a: a.isNotNull()))
    p = F.col("p")
    flat = out.select(*keep, "resource", "scope", i["name"].alias("name"), F.nullif(i["unit"], F.lit("")).alias("unit"), i.isNull().alias("empty"), F.explode_outer(points).alias("p"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    bad = (
        F.when(F.col("empty"), EMPTY).when(F.trim(F.coalesce("name", F.lit(""))) == "", "metric has no name").when(p.isNull(), "metric has no points")
        .when(p["temporality"].isNull(), "unknown temporality")
        .when(F.coalesce(p["t"], F.lit(0)) <= 0, "metric time is missing")
        .when(F.coalesce(p["start_time"], F.lit(0)) > p["t"], "metric starts after its time")
        .when(p["value"].isNull() | F.isnan(p["value"]) | (F.abs(p["value"]) == float("inf")), "metric value is not finite")
        .when(p["kind"] == "histogram", histogram_problem(p["bounds"], p["counts"], p["count"], p["min"], p["max"]))
        .when((p["kind"] == "exponential") & (p["scale"].isNull() | (total(p["positive"]) + total(p["negative"]) + F.coalesce(p["zero_count"], F.lit(0)) != p["count"])), "exponential buckets don't add up")
    )
    return flat.select(*keep, F.lit(project).alias("project"), environment(F.col("resource")).alias("environment"), "resource", "scope", "name", "unit", "p.kind", "p.temporality", attributes(p["attributes"]).alias("attributes"), "p.start_time", "p.t", "p.stale", "p.value", "p.exemplars", "p.count", "p.counts", "p.bounds", "p.min", "p.max", "p.scale", bad.alias("error"))
