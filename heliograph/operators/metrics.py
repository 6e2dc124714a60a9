"""Metric operators: totals with counter resets, rollups, histogram merges, cardinality limits, pages."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.values import NANO, floor_to, max_value, min_value

ROLLUP_SECONDS = (60, 3600)
MAX_SERIES = 10_000
MAX_POINTS = 100_000
SHARES = 64
FUNCTIONS = ("raw", "sum", "avg", "min", "max", "count", "rate")


def series_id(*parts: Column) -> Column:
    """SHA-256 over the JSON of what makes a series itself; pass maps as identity() text."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def limit_cardinality(points: DataFrame, identity: list[str], scope: list[str], most: int = MAX_SERIES) -> DataFrame:
    """Points with `overflow`: true for series of a scope that are first seen after its first `most`.

    First sightings are one row a series before they are ranked; ranks take the
    series of a scope in the order of their smallest cursor.  Shares of a scope
    are cut to `most` series each before the scope's own ranks are taken, so no
    task sorts all series of a scope.
    """
    first = points.groupBy(*scope, *identity).agg(F.min("cursor").alias("_first"))
    # Only the series number `most` matters: its first cursor is the scope's threshold.
    share = Window.partitionBy(*scope, F.pmod(F.xxhash64(*identity), F.lit(SHARES))).orderBy("_first")
    some = first.withColumn("_k", F.row_number().over(share)).where(F.col("_k") <= most)
    at = some.withColumn("_k", F.row_number().over(Window.partitionBy(*scope).orderBy("_first"))).where(F.col("_k") == most).select(*scope, F.col("_first").alias("_last"))
    ranked = first.join(at, scope, "left").select(*scope, *identity, F.coalesce(F.col("_first") > F.col("_last"), F.lit(False)).alias("overflow"))
    return points.join(ranked, [*scope, *identity])


def fold_overflow(points: DataFrame, identity: list[str], scope: list[str], most: int = MAX_SERIES) -> DataFrame:
    """Points where those beyond the first `most` series of a scope have lost their identity (null) and carry `overflow`.

    So all of them are one series of the scope's name, unit and temporality, of
    which whatever groups by scope, identity and overflow makes one row.
    """
    marked = limit_cardinality(points, identity, scope, most)
    return marked.withColumns({c: F.when(~F.col("overflow"), F.col(c)) for c in identity})


def _order() -> list[str]:
    return ["t", "cursor"]


def steps(points: DataFrame, by: list[str]) -> DataFrame:
    """Points that are not stale, with the increase since the one before (reset: the value, at least 0) and whether it was a reset."""
    w = Window.partitionBy(*by).orderBy(*_order())
    out = points.where("NOT stale").withColumn("before", F.lag("value").over(w))
    up = F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.greatest(F.col("value"), F.lit(0.0)))
    return out.withColumn("increase", F.when(F.col("before").isNotNull(), up).otherwise(0.0)).withColumn("reset", (F.col("before").isNotNull() & ~(F.col("value") >= F.col("before"))).cast("long"))


def _last(c: str) -> Column:
    return F.max_by(c, F.struct(*_order()))


def totals(points: DataFrame, by: list[str], temporality: str) -> DataFrame:
    """Semantic total and resets of each series: gauge the last value, delta the sum, cumulative the increases."""
    if temporality == "cumulative":
        return steps(points, by).groupBy(*by).agg(F.sum("increase").alias("total"), F.sum("reset").alias("resets"))
    value = _last("value") if temporality == "gauge" else F.sum("value")
    return points.where("NOT stale").groupBy(*by).agg(value.alias("total"), F.lit(0).cast("long").alias("resets"))


def aggregate(points: DataFrame, by: list[str], temporality: str, function: str) -> DataFrame:
    """One value a series; series with stale points only have null (and `raw` too)."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function {function!r}")
    live = F.when(~F.col("stale"), F.col("value"))
    simple = {"sum": F.sum(live), "avg": F.sum(live) / F.count(live), "min": min_value(live), "max": max_value(live), "count": F.when(F.count(live) > 0, F.count(live).cast("double"))}
    if function in simple:
        return points.groupBy(*by).agg(simple[function].alias("value"))
    total = totals(points, by, temporality)
    span = points.groupBy(*by).agg(F.max(F.when(~F.col("stale"), F.col("t"))).alias("_b"), F.min(F.when(~F.col("stale"), F.col("t"))).alias("_a"))
    both = span.join(total, by, "left")
    if function == "raw":
        return both.select(*by, F.col("total").alias("value"))
    length = (F.col("_b") - F.col("_a")) / F.lit(float(NANO))
    return both.select(*by, F.when(length > 0, F.col("total") / length).alias("value"))


def rollup(points: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """Count, sum, min, max and last of the points that are not stale in each window."""
    window = floor_to(F.col("t"), seconds * NANO).alias("window_start")
    live = points.where("NOT stale").select("*", window)
    return live.groupBy(*by, "window_start").agg(F.count("*").alias("point_count"), F.sum("value").alias("sum"), min_value(F.col("value")).alias("min"), max_value(F.col("value")).alias("max"), _last("value").alias("last"))


def rollup_exemplars(points: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """The exemplars (trace, span) of each window, once each, in order."""
    window = floor_to(F.col("t"), seconds * NANO).alias("window_start")
    each = points.where("NOT stale").select(*by, window, F.explode("exemplars").alias("e")).select(*by, "window_start", F.col("e.trace_id").alias("trace_id"), F.col("e.span_id").alias("span_id")).distinct()
    return each.groupBy(*by, "window_start").agg(F.sort_array(F.collect_list(F.struct("trace_id", "span_id"))).alias("exemplars"))


def merge_histograms(rows: DataFrame, by: list[str], bounds: int) -> DataFrame:
    """Explicit histograms of equal bounds added up; different bounds within a group are an error.

    Buckets add up by position, so partial sums are made before the shuffle.
    """
    shape = F.to_json("bounds")
    same = F.when(F.min(shape) == F.max(shape), F.first("bounds", True)).otherwise(F.raise_error(F.lit("histogram bounds differ")).cast("array<double>"))
    counts = [F.sum(F.col("counts")[i]).alias(f"_c{i}") for i in range(bounds + 1)]
    out = rows.groupBy(*by).agg(same.alias("bounds"), *counts, F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    return out.select(*by, "bounds", F.array(*(f"_c{i}" for i in range(bounds + 1))).alias("counts"), "count", "sum", "min", "max")


def histogram_problem(bounds: Column, counts: Column, count: Column, low: Column, high: Column) -> Column:
    """Why a histogram is invalid, or null."""
    pairs = F.zip_with(F.slice(bounds, 1, F.greatest(F.size(bounds) - 1, F.lit(0))), F.slice(bounds, 2, F.size(bounds)), lambda a, b: a < b)
    return (
        F.when(F.size(counts) != F.size(bounds) + 1, "bucket counts don't fit the bounds")
        .when(F.exists(bounds, lambda b: F.isnan(b) | (F.abs(b) == float("inf"))), "bounds are not finite")
        .when(~F.forall(pairs, lambda p: p), "bounds don't grow")
        .when(F.aggregate(counts, F.lit(0).cast("long"), operator.add) != count, "bucket counts don't add up")
        .when(low > high, "min is above max")
    )


def to_classic(rows: DataFrame, by: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative bucket series with `le`, then count and sum series, of explicit histograms."""
    from heliograph.functions.values import plain_number

    running = [functools.reduce(operator.add, (F.col("counts")[j] for j in range(i + 1))) for i in range(len(bounds) + 1)]
    names = [plain_number(F.lit(float(b))) for b in bounds] + [F.lit("+Inf")]
    buckets = [F.struct(F.lit("bucket").alias("kind"), n.alias("le"), r.cast("double").alias("value")) for n, r in zip(names, running)]
    rest = [F.struct(F.lit("count").alias("kind"), F.lit("").alias("le"), F.col("count").cast("double").alias("value")), F.struct(F.lit("sum").alias("kind"), F.lit("").alias("le"), F.col("sum").alias("value"))]
    return rows.select(*by, F.explode(F.array(*buckets, *rest)).alias("x")).where("x.value IS NOT NULL").select(*by, "x.kind", "x.le", "x.value")


def newest_points(points: DataFrame, by: list[str], most: int = MAX_POINTS) -> DataFrame:
    """The newest points of each series; a limit of retention."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in _order()))
    return points.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def series_page(rows: DataFrame, limit: int, after: str | None = None, key: str = "series_id") -> DataFrame:
    """The next rows by key: limit + 1, so that the caller sees whether there are more."""
    some = rows if after is None else rows.where(F.col(key) > after)
    return some.orderBy(key).limit(limit + 1)
