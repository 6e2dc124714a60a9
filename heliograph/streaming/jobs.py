"""Structured Streaming: sources, incremental views, exact deduplication, alert state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heliograph.functions.values import NANO, floor_to
from heliograph.operators import alerts
from heliograph.operators.ingest import DEDUPE_SECONDS


def read_events(spark: SparkSession, path: str, schema: str, *, form: str = "parquet", files: int | None = None) -> DataFrame:
    """A folder of files as a stream: offsets are the checkpoint's, each file is read once."""
    reader = spark.readStream.format(form).schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(path)


def tail_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a growing folder with their file's path."""
    return spark.readStream.format("text").load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def dedupe(events: DataFrame, seconds: int = DEDUPE_SECONDS, *, late: str = "10 minutes") -> DataFrame:
    """First accepted delivery of each (project, event_id); repeats up to `seconds` after it, the limit included, go.

    State is one time a key.  Accept times come nearly in order, so the
    watermark follows them by `late`; it ends a key's state once no repeat can
    be inside the window.
    """
    out = "project string, event_id string, cursor long, accepted timestamp"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -math.inf
        rows = pd.concat(batches).sort_values(["accepted", "cursor"], kind="stable")
        kept = []
        for cursor, at in zip(rows["cursor"], rows["accepted"]):
            micros = at.value // 1000
            if last < micros - seconds * 1_000_000:
                kept.append((*key, cursor, at))
                last = micros
        end = int(last) // 1000 + seconds * 1000 + 1
        if end <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        else:
            state.update((int(last),))
            state.setTimeoutTimestamp(end)
        if kept:
            yield pd.DataFrame(kept, columns=["project", "event_id", "cursor", "accepted"])

    return events.select("project", "event_id", "cursor", "accepted").withWatermark("accepted", late).groupBy("project", "event_id").applyInPandasWithState(fold, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def rollups(points: DataFrame, by: list[str], seconds: int, *, late: str = "1 hour", time: str = "at") -> DataFrame:
    """Windows of points that are not stale; a late point changes its window as long as the watermark keeps it."""
    window = F.window(time, f"{seconds} seconds")
    out = points.where("NOT stale").withWatermark(time, late).groupBy(*by, window).agg(F.count("*").alias("point_count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", F.struct(time, "cursor")).alias("last"))
    return out.select(*by, F.col("window.start").alias("window_start"), "point_count", "sum", "min", "max", "last")


def alert_states(observations: DataFrame, rule: alerts.Rule) -> DataFrame:
    """The alert state machine over a stream of (series, t, kind, truth, cursor)."""
    fields = "phase string, active boolean, episode long, pending long, evaluated long, cursor long, notified long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alert = alerts.alert_id(rule.rule_id, {"series": key[0]})
        now = alerts.State(alert)
        if state.exists:
            phase, active, episode, pending, evaluated, cursor, notified = state.get
            now = alerts.State(alert, phase, active, episode, None if pending < 0 else pending, evaluated, cursor, notified)
        rows = pd.concat(batches).sort_values("t", kind="stable")
        out = []
        for t, kind, truth, cursor in zip(rows["t"], rows["kind"], rows["truth"], rows["cursor"]):
            if t < now.evaluated:
                continue  # the clock does not go back
            now, news = alerts.observe(rule, now, alerts.Seen(kind, bool(truth), int(cursor)), int(t))
            if news:
                out.append((key[0], int(t), news, now.episode, alerts.notification_id(rule.project, alert, now.episode, news)))
        state.update((now.phase, now.active, now.episode, -1 if now.pending_since is None else now.pending_since, now.evaluated, now.event_cursor, now.notified))
        if out:
            yield pd.DataFrame(out, columns=["series", "t", "transition", "episode", "notification_id"])

    return observations.groupBy("series").applyInPandasWithState(fold, "series string, t long, transition string, episode long, notification_id string", fields, "append", GroupStateTimeout.NoTimeout)


def maintain_rollups(points: DataFrame, path: str, checkpoint: str, by: list[str], seconds: int) -> StreamingQuery:
    """Keep rolled-up partials in a table, one folder a batch: a batch that runs again replaces its own folder.

    Readers add the partials up with merged_rollups(), so late points need no rewrite.
    """

    def write(batch: DataFrame, number: int) -> None:
        start = floor_to(F.col("t"), seconds * NANO).alias("window_start")
        order = F.struct("t", "cursor")
        part = batch.where("NOT stale").groupBy(*by, start).agg(F.count("*").alias("point_count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max(F.struct(order.alias("order"), F.col("value"))).alias("last"), F.max("cursor").alias("cursor"))
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_rollups(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "window_start").agg(F.sum("point_count").alias("point_count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("last").alias("last")).withColumn("last", F.col("last.value"))


class LagError(RuntimeError):
    def __init__(self, wanted: int, applied: int):
        super().__init__(f"the view is at cursor {applied}, {wanted} was asked for")
        self.wanted, self.applied = wanted, applied


def wait_for(view: DataFrame, cursor: int, query: StreamingQuery | None = None) -> int:
    """Read your writes: the view's cursor once it is at least `cursor`, or a LagError."""
    if query is not None and query.isActive:
        query.processAllAvailable()
    applied = view.agg(F.max("cursor")).first()[0] or 0
    if applied < cursor:
        raise LagError(cursor, applied)
    return applied
