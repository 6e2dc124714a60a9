"""Error grouping: classification, fingerprints, groups and recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.values import json_at, json_text

#: Parts of a message that vary from one occurrence to the next: UUIDs, hex numbers, numbers.  A fixed value: fingerprints must agree.
VOLATILE = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b0x[0-9a-f]+\b|\b\d+(?:\.\d+)?\b"
MAX_VERSIONS, SAMPLES = 100, 3
#: Records that one page of the feed takes at most.
FEED_PAGE = 500
SHARES = 64


def fingerprint(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, VOLATILE, "?"), r"(?U)\s+", " "))


def text_field(attributes: Column, payload: Column, name: str) -> Column:
    """A string field from the attributes, the payload, its `json` part, or one level down in either."""
    paths = [[name], ["json", name]]
    if "." in name:
        first, rest = name.split(".", 1)
        paths += [[first, rest], ["json", first, rest]]
    found = [F.when(json_at(payload, p).startswith('"'), json_text(json_at(payload, p))) for p in paths]
    return F.coalesce(F.try_element_at(attributes, F.lit(name)), *found)


def is_error(kind: Column, severity: Column) -> Column:
    return (F.coalesce(kind, F.lit("log_error")) != "log_error") | F.coalesce(F.upper(severity).isin("ERROR", "FATAL", "CRITICAL"), F.lit(False))


def group_id(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*parts)), 256)


def classified(logs: DataFrame, *, kind: Column | None = None, text: Column | None = None) -> DataFrame:
    """Error logs with their exception type, fingerprint and group id."""
    kind = F.lit("log_error") if kind is None else F.coalesce(kind, F.lit("log_error"))
    out = logs.where(is_error(kind, F.col("severity"))).withColumn("exception_type", kind).withColumn("fingerprint", fingerprint(F.col("body") if text is None else F.coalesce(text, F.col("body"))))
    return out.withColumn("group_id", group_id(F.col("project"), F.col("environment"), F.coalesce("service", F.lit("unknown")), F.col("exception_type"), F.col("fingerprint")))


def groups(errors: DataFrame) -> DataFrame:
    """One row a group: counts, first and last sighting, the last three samples' cursors.

    Every part is an algebraic aggregate but the samples, which come from a
    top-3 by group: no group is gathered.
    """
    by = ["group_id", "project", "environment", "service", "exception_type", "fingerprint"]
    last = Window.partitionBy("group_id").orderBy(F.col("cursor").desc())
    samples = errors.select("group_id", "cursor").withColumn("k", F.row_number().over(last)).where(f"k <= {SAMPLES}").groupBy("group_id").agg(F.sort_array(F.collect_list("cursor")).alias("samples"))
    main = errors.groupBy(*by).agg(
        F.count("*").alias("count"), F.min("occurred_ns").alias("first_seen"), F.max("occurred_ns").alias("last_seen"), F.min("cursor").alias("first_cursor"), F.max("cursor").alias("last_cursor")
    )
    return main.join(samples, "group_id")


def versions(errors: DataFrame, version: Column, most: int = MAX_VERSIONS) -> DataFrame:
    """group_id and the sorted versions it was seen with: the first `most` by the cursor of their first sighting.

    Records without a version (null) add none; a group without any has no row.
    A group's versions are cut to `most` in each of its shares first, so no task
    sorts all versions of a group.
    """
    first = errors.withColumn("_version", version).where("_version IS NOT NULL").groupBy("group_id", "_version").agg(F.min("cursor").alias("_first"))
    for by in (["group_id", F.pmod(F.xxhash64("_version"), F.lit(SHARES))], ["group_id"]):
        first = first.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_first", "_version"))).where(F.col("_k") <= most).drop("_k")
    return first.groupBy("group_id").agg(F.sort_array(F.collect_list("_version")).alias("versions"))


def feed(logs: DataFrame, after: int, most: int = FEED_PAGE) -> tuple[DataFrame, int]:
    """Errors among the next page of records past the cursor `after`, and the cursor to go on from.

    Whoever stores the cursor with the page's results takes each record exactly
    once; past the last record the page is empty and the cursor stays.
    """
    if not 1 <= most <= FEED_PAGE:
        raise ValueError(f"a page holds 1 to {FEED_PAGE} records")
    ahead = logs.where(F.col("cursor") > after)
    end = ahead.select("cursor").orderBy("cursor").limit(most).agg(F.max("cursor")).first()[0]
    end = after if end is None else end
    return classified(ahead.where(F.col("cursor") <= end)), end


def recurrence(errors: DataFrame, changes: DataFrame) -> DataFrame:
    """Status of each group after status changes (group_id, cursor, status).

    An occurrence after `resolved` opens the group again and counts as one
    recurrence; further ones don't until it is resolved again.
    """
    both = errors.select("group_id", "cursor", F.lit("seen").alias("what")).unionByName(changes.select("group_id", "cursor", F.col("status").alias("what")))
    w = Window.partitionBy("group_id").orderBy("cursor", F.when(F.col("what") == "seen", 1).otherwise(0))
    steps = both.withColumn("before", F.lag("what").over(w))
    again = (F.col("what") == "seen") & (F.col("before") == "resolved")
    order = F.struct("cursor", F.when(F.col("what") == "seen", 1).otherwise(0))
    last_change = F.max_by(F.when(F.col("what") != "seen", F.col("what")), F.when(F.col("what") != "seen", order))
    last = F.max_by("what", order)
    return steps.groupBy("group_id").agg(
        F.when((last == "seen") & (F.coalesce(last_change, F.lit("resolved")) == "resolved"), "open").otherwise(F.coalesce(last_change, F.lit("open"))).alias("status"),
        F.sum(again.cast("long")).alias("recurrence_count"),
        F.max(F.when(again, F.col("cursor"))).alias("recurrence_cursor"),
    )
