"""Values of series at evaluation steps, without a range join.

Each point knows the steps it is seen at: they are generated from it, so the
cost follows the visible (series, step) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.values import NANO

LOOKBACK = 300 * NANO


def _between(low: Column, high: Column, start: int, step: int, count: int) -> Column:
    """Numbers of the steps at times in [low, high]."""
    width = F.lit(step).cast("long")
    up, down = low - start, high - start
    # Integer division of exact multiples: nanoseconds exceed what a double holds.
    first = F.greatest(F.lit(0).cast("long"), F.call_function("div", up + F.pmod(-up, width), width))
    last = F.least(F.lit(count - 1).cast("long"), F.call_function("div", down - F.pmod(down, width), width))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def instant(points: DataFrame, by: list[str], start: int, step: int, count: int, *, closed: bool = True, lookback: int = LOOKBACK) -> DataFrame:
    """by, k, value: the newest point at or before step k, unless it is stale or too old.

    closed: a point exactly as old as the look-back is still seen.
    """
    w = Window.partitionBy(*by).orderBy("t", "cursor")
    seen = points.withColumn("_next", F.lead("t").over(w)).where("NOT stale")
    end = F.least(F.coalesce(F.col("_next") - 1, F.lit((1 << 63) - 1)), F.col("t") + (lookback if closed else lookback - 1))
    return seen.select(*by, F.explode(_between(F.col("t"), end, start, step, count)).alias("k"), "value")


def simple_rate(points: DataFrame, by: list[str], start: int, step: int, count: int, *, lookback: int = LOOKBACK) -> DataFrame:
    """Increase over time between the first and last point in (step - lookback, step], without extrapolation.

    A stale point ends the epoch: only points after the newest one count.
    """
    w = Window.partitionBy(*by).orderBy("t", "cursor")
    marked = points.withColumn("epoch", F.sum(F.col("stale").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.where("stale").groupBy(*by, "epoch").agg(F.min("t").alias("_stale")).select(*by, (F.col("epoch") - 1).alias("epoch"), "_stale")
    epoch = Window.partitionBy(*by, "epoch").orderBy("t", "cursor")
    live = marked.where("NOT stale").withColumn("before", F.lag("value").over(epoch))
    up = F.when(F.col("before").isNull(), 0.0).when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.greatest(F.col("value"), F.lit(0.0)))
    live = live.withColumn("run", F.sum(up).over(epoch.rowsBetween(Window.unboundedPreceding, 0))).join(ends, [*by, "epoch"], "left")
    end = F.least(F.col("t") + lookback - 1, F.coalesce(F.col("_stale") - 1, F.lit((1 << 63) - 1)))
    at = live.select(*by, F.explode(_between(F.col("t"), end, start, step, count)).alias("k"), "t", "cursor", "run")
    order = F.struct("t", "cursor")
    per = at.groupBy(*by, "k").agg(F.min_by(F.struct("t", "run"), order).alias("a"), F.max_by(F.struct("t", "run"), order).alias("b"))
    length = F.col("b.t") - F.col("a.t")
    return per.where(length > 0).select(*by, "k", ((F.col("b.run") - F.col("a.run")) / (length / F.lit(float(NANO)))).alias("value"))


def _ends(live: DataFrame, by: list[str], start: int, step: int, count: int, window: int, carry: list[str]) -> DataFrame:
    """by, k, a, b: the first and the last point in (step - window, step], as structs of `carry`, where there are any.

    Each series' first row brings two marks for every step whose window can hold
    a point; the marks are sorted in among the points, and each takes the point
    beside it.  So the rows are points plus steps, whatever the window is to the
    step, and all of it happens in the one shuffle by series.
    """
    w, whole = Window.partitionBy(*by).orderBy("t", "cursor"), Window.partitionBy(*by)
    own = F.struct(F.col("t").alias("at"), F.lit(0).alias("mark"), F.col("cursor").alias("c"), F.lit(None).cast("long").alias("k"), F.struct(*carry).alias("p"))
    mark = lambda k, side: F.struct((F.lit(start - window * side) + k * step).alias("at"), F.lit(1 + side).alias("mark"), F.lit(0).cast("long").alias("c"), k.alias("k"), F.lit(None).cast(live.select(F.struct(*carry)).schema[0].dataType).alias("p"))
    steps = _between(F.min("t").over(whole), F.max("t").over(whole) + (window - 1), start, step, count)
    first = live.withColumn("_steps", F.when(F.row_number().over(w) == 1, steps).otherwise(F.array().cast("array<bigint>")))
    rows = first.select(*by, F.explode(F.concat(F.array(own), F.flatten(F.transform("_steps", lambda k: F.array(mark(k, 0), mark(k, 1)))))).alias("r")).select(*by, "r.*")
    # A mark comes after the points of its own time: a point at a step belongs to it, one a whole window back does not.
    up = Window.partitionBy(*by).orderBy("at", F.least("mark", F.lit(1)), "c")
    down = Window.partitionBy(*by).orderBy(F.col("at").desc(), F.least("mark", F.lit(1)).desc(), F.col("c").desc())
    before = F.last("p", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("p", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    beside = rows.withColumn("_b", before).withColumn("_a", after).where("mark > 0")
    return beside.groupBy(*by, "k").agg(F.max(F.when(F.col("mark") == 2, F.col("_a"))).alias("a"), F.max(F.when(F.col("mark") == 1, F.col("_b"))).alias("b"))


def window_change(points: DataFrame, by: list[str], start: int, step: int, count: int, window: int, *, increase: bool) -> DataFrame:
    """Extrapolated increase or rate over (step - window, step] of points that are not stale.

    A point below the one before, or with another start time (`start_time`, if
    the points have it), is a reset and adds the value before.  Points that share a time
    are an error.  Running sums make a window the difference of its ends.
    """
    w = Window.partitionBy(*by).orderBy("t", "cursor")
    live = points.where("NOT stale").withColumn("before", F.lag("value").over(w)).withColumn("_twin", F.coalesce(F.lag("t").over(w) == F.col("t"), F.lit(False)))
    reset = F.col("value") < F.col("before")
    if "start_time" in points.columns:
        live = live.withColumn("_was", F.lag("start_time").over(w))
        reset = reset | F.coalesce((F.col("_was") != F.col("start_time")) & (F.col("start_time") != 0), F.lit(False))
    add = F.when(reset, F.col("before")).otherwise(0.0)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    live = live.withColumn("shift", F.sum(F.coalesce(add, F.lit(0.0))).over(running)).withColumn("i", F.row_number().over(w)).withColumn("_twins", F.sum(F.col("_twin").cast("long")).over(running))
    per = _ends(live, by, start, step, count, window, ["t", "value", "shift", "i", "_twins"]).where("b.i > a.i").withColumn("n", F.col("b.i") - F.col("a.i") + 1)
    twins = F.col("b._twins") > F.col("a._twins")
    change = (F.col("b.value") + F.col("b.shift")) - (F.col("a.value") + F.col("a.shift"))
    nano = F.lit(float(NANO))
    per = per.select(*by, "k", "n", change.alias("change"), F.col("a.value").alias("first"), ((F.col("b.t") - F.col("a.t")) / nano).alias("sampled"), ((F.col("a.t") - (F.lit(start - window) + F.col("k") * step)) / nano).alias("before"), ((F.lit(start) + F.col("k") * step - F.col("b.t")) / nano).alias("after"), twins.alias("twins"))
    spacing = F.col("sampled") / (F.col("n") - 1)
    before = F.when((F.col("change") > 0) & (F.col("first") >= 0), F.least("before", F.try_divide(F.col("sampled") * F.col("first"), F.col("change")))).otherwise(F.col("before"))
    per = per.withColumn("spacing", spacing).withColumn("before", before)
    edge = lambda c: F.when(F.col(c) >= F.col("spacing") * 1.1, F.col("spacing") / 2).otherwise(F.col(c))
    value = F.col("change") * (F.col("sampled") + edge("before") + edge("after")) / F.col("sampled")
    value = value if increase else value / (window / NANO)
    bad = F.raise_error(F.lit("metric samples share a timestamp")).cast("double")
    return per.select(*by, "k", F.when(F.col("twins"), bad).otherwise(value).alias("value"))


def delta_change(points: DataFrame, by: list[str], start: int, step: int, count: int, window: int, *, increase: bool) -> DataFrame:
    """Sum of delta points over (step - window, step]; their intervals must tile the window exactly, else an error."""
    w = Window.partitionBy(*by).orderBy("t", "cursor")
    live = points.where("NOT stale").withColumn("_gap", F.coalesce(F.lag("t").over(w) != F.col("start_time"), F.lit(False)) | F.col("start_time").isNull() | (F.col("start_time") >= F.col("t")))
    at = live.select(*by, F.explode(_between(F.col("t"), F.col("t") + (window - 1), start, step, count)).alias("k"), "t", "cursor", "start_time", "value", "_gap")
    order = F.struct("t", "cursor")
    per = at.groupBy(*by, "k").agg(F.sum("value").alias("total"), F.min_by("start_time", order).alias("a"), F.max("t").alias("b"), F.count_if("_gap").alias("gaps"), F.min_by("_gap", order).alias("first_gap"))
    end = F.lit(start) + F.col("k") * step
    fits = (F.col("a") == end - window) & (F.col("b") == end) & (F.col("gaps") - F.col("first_gap").cast("long") == 0)
    value = F.col("total") if increase else F.col("total") / (window / NANO)
    return per.select(*by, "k", F.when(F.coalesce(fits, F.lit(False)), value).otherwise(F.raise_error(F.lit("delta intervals don't tile the window")).cast("double")).alias("value"))
