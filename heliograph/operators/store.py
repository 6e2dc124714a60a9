"""Storage operators: cold and hot union, ordered merge, retention, digests, shard routes, unused blobs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: Rows of a shard map.
MAX_EPOCHS = 10_000
DAY_NS = 86_400 * 1_000_000_000


def write_events(events: DataFrame, path: str) -> None:
    """Append events as Parquet by signal and day, sorted by time in each file, so that scans prune."""
    day = F.to_date(F.timestamp_micros(F.expr("occurred_ns div 1000")))
    events.withColumn("day", day).repartition("signal", "day", F.pmod(F.xxhash64("event_id"), F.lit(16))).sortWithinPartitions("signal", "day", "occurred_ns").write.mode("append").partitionBy("signal", "day").option("compression", "snappy").parquet(path)


def scan(events: DataFrame, *, start: int | None = None, stop: int | None = None, after: int | None = None) -> DataFrame:
    """Half-open time range, with the day bounds that prune partitions where the table has days."""
    for bound, test in ((start, lambda c, v: c >= v), (stop, lambda c, v: c < v)):
        if bound is not None:
            events = events.where(test(F.col("occurred_ns"), bound))
    if "day" in events.columns:
        if start is not None:
            events = events.where(F.col("day") >= F.to_date(F.timestamp_micros(F.lit(start // 1000))))
        if stop is not None:
            events = events.where(F.col("day") <= F.to_date(F.timestamp_micros(F.lit(stop // 1000))))
    return events if after is None else events.where(F.col("cursor") > after)


def cold_and_hot(cold: DataFrame, hot: DataFrame, watermark: int) -> DataFrame:
    """The archive through the watermark, then the live table after it: no row twice."""
    return cold.where(F.col("cursor") <= watermark).unionByName(hot.where(F.col("cursor") > watermark))


def needs_archive(start_ns: int, now_ns: int, days: int = 30) -> bool:
    return start_ns < now_ns - days * DAY_NS


def merge_ordered(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("cursor")


def expire(events: DataFrame, cutoff_ns: int) -> tuple[DataFrame, DataFrame]:
    """Events to keep and the ranges of cursors that go (gap and island over those that go)."""
    gone = events.where(F.col("occurred_ns") < cutoff_ns).select("project", "cursor")
    island = F.col("cursor") - F.row_number().over(Window.partitionBy("project").orderBy("cursor"))
    ranges = gone.withColumn("_i", island).groupBy("project", "_i").agg(F.min("cursor").alias("first"), F.max("cursor").alias("last"), F.count("*").alias("n")).drop("_i")
    return events.where(F.col("occurred_ns") >= cutoff_ns), ranges


def set_digest(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Exclusive or of the SHA-256 of all values, as hex: independent of order, added up before the shuffle."""
    h = F.sha2(value, 256)
    part = [F.bit_xor(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"_d{i}") for i in range(8)]
    out = rows.groupBy(*by).agg(*part, F.count("*").alias("n"))
    return out.select(*by, F.concat(*(F.lpad(F.lower(F.hex(f"_d{i}")), 8, "0") for i in range(8))).alias("digest"), "n")


def shard(key: Column) -> Column:
    """Bucket 0 to 4095 from the first two bytes of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("int").bitwiseAND(BUCKETS - 1)


def route(rows: DataFrame, epochs: DataFrame) -> DataFrame:
    """The shard map epoch in force at each row's cursor: the last activation not after it.

    The map is a control table of MAX_EPOCHS rows at most (more are an error).
    It travels as one sorted array in which each row's place is found by
    halving: no join, no shuffle, no pairs.  Rows before the first activation get nulls.
    """
    rest = [c for c in epochs.columns if c != "activation"]
    known = epochs.orderBy("activation").limit(MAX_EPOCHS + 1).collect()
    if len(known) > MAX_EPOCHS:
        raise ValueError(f"a shard map has at most {MAX_EPOCHS} epochs")
    kind = "array<struct<" + ", ".join(f"`{c}`: {epochs.schema[c].dataType.simpleString()}" for c in ("activation", *rest)) + ">>"
    table = F.from_json(F.lit(json.dumps([{c: r[c] for c in ("activation", *rest)} for r in known])), kind)
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(MAX_EPOCHS.bit_length()))))
    place = F.aggregate(halves, F.lit(0), lambda at, s: F.when((at + s <= len(known)) & (F.try_element_at(table, at + s)["activation"] <= F.col("cursor")), at + s).otherwise(at))
    found = rows.withColumn("_epoch", F.try_element_at(table, F.when(place > 0, place)))
    return found.select("*", *(F.col("_epoch")[c].alias(c) for c in rest)).drop("_epoch")


def unused(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    return blobs.join(refs.select("hash").distinct(), "hash", "left_anti")


def evict(hot: DataFrame, archived: DataFrame, now_ns: int, days: int = 30) -> DataFrame:
    """The live table without whole days that are older than `days` and are in the archive in full.

    A day is in the archive in full if both sides count the same events of it.
    """
    day = (F.col("occurred_ns") - F.pmod(F.col("occurred_ns"), F.lit(DAY_NS))).alias("_day")
    here = hot.groupBy(day).agg(F.count("*").alias("_n"))
    there = archived.groupBy(day).agg(F.count("*").alias("_m"))
    gone = here.join(there, "_day").where((F.col("_n") == F.col("_m")) & (F.col("_day") + DAY_NS <= now_ns - days * DAY_NS)).select("_day")
    return hot.withColumn("_day", F.col("occurred_ns") - F.pmod(F.col("occurred_ns"), F.lit(DAY_NS))).join(gone, "_day", "left_anti").drop("_day")


def rebuilt_differs(live: DataFrame, rebuilt: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Keys whose rows differ between a live view and its rebuild, by set digests."""
    a, b = (set_digest(x, value, by) for x in (live, rebuilt))
    b = b.select(*by, F.col("digest").alias("rebuilt"), F.col("n").alias("rebuilt_n"))
    return a.join(b, by, "full").where(~F.col("digest").eqNullSafe(F.col("rebuilt")) | ~F.col("n").eqNullSafe(F.col("rebuilt_n")))


SOURCE_ROWS, SOURCE_BYTES = 250_000, 64 << 20


def within_budget(rows: DataFrame, most: int = SOURCE_ROWS, size: int = SOURCE_BYTES) -> DataFrame:
    """The rows themselves, if a request may load them: at most `most` rows and `size` bytes as JSON, else an error.

    Not more than `most` + 1 rows are counted and weighed.
    """
    some = rows.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).limit(most + 1)
    count, held = some.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count > most or held > size:
        raise ValueError(f"the request needs more than {most} rows or {size} bytes: narrow it")
    return rows
