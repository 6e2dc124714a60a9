"""Ingest transforms: admission, validation, governance, deduplication, cursors, normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.values import json_at, json_text

DEDUPE_SECONDS = 6 * 3600
QUOTA_ITEMS, QUOTA_SECONDS = 720_000, 60
MAX_STRING_BYTES = 4096
REDACTED = "[REDACTED]"
#: Keys (without a bytes or base64 ending) that hold model content.  Fixed values: policies must agree on them.
CONTENT_KEYS = ("prompt", "prompts", "completion", "completions", "response", "responses", "message", "messages", "input", "output", "system_instruction", "system_instructions")
CONTENT_PATHS = ("gen_ai.prompt", "gen_ai.completion", "gen_ai.input.messages", "gen_ai.output.messages", "gen_ai.system_instructions", "llm.input_messages", "llm.output_messages")
CONTENT_ENDINGS = (".prompt", ".completion", ".response", ".messages")


def rejection(*, min_cursor: int = 0) -> Column:
    """Why an event row is invalid, or null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(blank("event_id"), "event_id is blank")
        .when(blank("project"), "project is blank")
        .when(blank("environment"), "environment is blank")
        .when(F.col("occurred_ns").isNull(), "occurred_at is not a time")
        .when(F.coalesce(F.col("payload"), F.lit("null")) == "null", "payload is null")
        .when(F.col("value").isNotNull() & (F.isnan("value") | (F.abs("value") == float("inf"))), "metric value is not finite")
        .when(F.col("cursor") < min_cursor, "cursor is out of order")
    )


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = events.withColumn("reason", rejection())
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def batch_messages(rejected: DataFrame, by: str, most: int = 8) -> DataFrame:
    """Rejected items and the first messages of each batch: partial success."""
    k = Window.partitionBy(by).orderBy("cursor")
    first = rejected.withColumn("_k", F.row_number().over(k))
    return first.groupBy(by).agg(F.count("*").alias("rejected"), F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", "reason")))).alias("m")).select(by, "rejected", F.array_join(F.transform("m", lambda x: x["reason"]), "; ").alias("messages"))


def over_quota(events: DataFrame, items: int = QUOTA_ITEMS, seconds: int = QUOTA_SECONDS, time: str = "occurred_ns") -> DataFrame:
    """Tumbling windows in which a project sends more than its quota."""
    width = seconds * 1_000_000_000
    w = (F.col(time) - F.pmod(F.col(time), F.lit(width).cast("long"))).alias("window_start")
    return events.groupBy("project", w).agg(F.count("*").alias("items")).withColumn("over", F.col("items") > items)


def retained(events: DataFrame, now_ns: int, days: int, time: str = "occurred_ns") -> DataFrame:
    """Events no older than 1 to 180 days; the limit itself is kept."""
    if not 1 <= days <= 180:
        raise ValueError("1 to 180 days")
    return events.where(F.col(time) >= now_ns - days * 86_400 * 1_000_000_000)


def truncated(text: Column, most: int = MAX_STRING_BYTES) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that ends between characters."""
    raw = text.cast("binary")
    # The cut falls back over at most three continuation bytes (10xxxxxx).
    at = F.lit(most)
    for back in (3, 2, 1, 0):
        inside = F.hex(F.substring(raw, most + 1 - back, 1)).rlike("^[89AB]")
        at = F.when(~inside, F.lit(most - back)).otherwise(at) if back == 3 else F.when(~inside, F.lit(most - back)).otherwise(at)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), at).cast("string"))


def is_content_key(key: Column) -> Column:
    k = F.regexp_replace(F.lower(key), "base64$", "")
    bare = F.regexp_replace(k, r"[_.]+$", "")
    bare = F.regexp_replace(F.when(bare.endswith("bytes"), F.regexp_replace(bare, "bytes$", "")).otherwise(k), r"[_.]+$", "")
    out = bare.isin(*CONTENT_KEYS, *CONTENT_PATHS)
    for end in CONTENT_ENDINGS:
        out = out | bare.endswith(end)
    return out


def is_model_event(attributes: Column) -> Column:
    return F.exists(F.map_keys(attributes), lambda k: F.lower(k).startswith("gen_ai.") | F.lower(k).startswith("llm."))


def govern(attributes: Column, *, allowed: list[str] | None = None, denied: list[str] = (), content: bool = False, text: str = REDACTED, most: int = MAX_STRING_BYTES) -> Column:
    """String attributes under a policy: lists without regard to case, model content redacted, the rest cut to size."""
    model = is_model_event(attributes)

    def one(k: Column, v: Column) -> Column:
        hide = F.lower(k).isin(*(x.lower() for x in denied)) if denied else F.lit(False)
        if allowed is not None:
            hide = hide | ~F.lower(k).isin(*(x.lower() for x in allowed))
        if not content:
            hide = hide | (model & is_content_key(k))
        return F.when(hide, text).otherwise(truncated(v, most))

    return F.transform_values(attributes, one)


def dedupe(rows: DataFrame, window: int, *, key: tuple[str, ...] = ("project", "event_id"), time: str = "accepted") -> DataFrame:
    """Rows with `original`: the cursor of the accepted row that they repeat, their own if they are accepted.

    A repeat within `window` of the accepted row's time, the limit included, is
    a duplicate; a later one is accepted and opens a new window.  The fold is
    greedy, so it runs over each key's sorted times in one expression; a key's
    deliveries are two numbers each.
    """
    every = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("cursor", F.col(time).alias("at")))).alias("a"))
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("cursor"), F.expr("cast(array() AS array<struct<cursor: bigint, original: bigint>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["at"].isNull() | (acc["at"] < x["at"] - window)
        original = F.when(new, x["cursor"]).otherwise(acc["cursor"])
        return F.struct(F.when(new, x["at"]).otherwise(acc["at"]).alias("at"), original.alias("cursor"), F.concat(acc["out"], F.array(F.struct(x["cursor"].alias("cursor"), original.alias("original")))).alias("out"))

    out = every.select(*key, F.explode(F.aggregate("a", zero, step)["out"]).alias("x"))
    return out.select(*key, "x.cursor", "x.original")


def with_cursors(events: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Contiguous cursors after `start`, in order: counts by range partition, then numbers inside each.

    No row_number over one global window: each range is sorted on its own.
    """
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from heliograph.sources.tables import written

    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_base")
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_p").withColumn("cursor", F.col("_k") + F.col("_base") + start).drop("_p", "_k", "_base")


def stable_id(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL: the same event gets the same id again."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def body_text(attributes: Column, payload: Column) -> Column:
    """The text of a log: body attribute, then message or body of the JSON payload, then of the payload, else the payload's JSON."""
    inner = F.coalesce(json_at(payload, ["jsonPayload"]), json_at(payload, []))
    first = F.coalesce(json_at(inner, ["message"]), json_at(inner, ["body"]), json_at(payload, ["body"]), json_at(payload, ["message"]))
    return F.coalesce(F.try_element_at(attributes, F.lit("otel.log.body")), F.when(first.startswith('"'), json_text(first)), inner)


def blobs(events: DataFrame, column: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Events with long base64 payloads replaced by content addresses, and the distinct blobs."""
    raw = F.unbase64(column)
    big = F.length(column) >= least
    address = F.concat(F.lit("sha256:"), F.sha2(raw, 256))
    out = events.withColumn("blob_ref", F.when(big, F.struct(address.alias("hash"), F.octet_length(raw).cast("long").alias("size"), F.lit("base64").alias("encoding")))).withColumn(column, F.when(~big, F.col(column)))
    table = events.where(big).select(address.alias("hash"), raw.alias("content")).groupBy("hash").agg(F.any_value("content").alias("content"))
    return out, table


def govern_by_project(project: Column, attributes: Column, policies: dict[str, dict], default: dict | None = None) -> Column:
    """Each project's own policy, else the default one; policies are plan-time settings, so no join is needed."""
    out = govern(attributes, **(default or {}))
    for name, policy in policies.items():
        out = F.when(project == name, govern(attributes, **policy)).otherwise(out)
    return out


EVENT_VERSION = 2


def decode_events(raw: DataFrame, column: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events from their JSON form: version 2 only; `error` says why a row is none."""
    doc = F.to_json(F.try_parse_json(F.col(column)))
    get = lambda *path: json_at(F.col("_doc"), [*path])
    text = lambda k: F.when(get(k).startswith('"'), json_text(get(k)))
    from heliograph.sources.lines import nanos

    fields = {k: text(k) for k in ("event_id", "project", "environment", "signal", "severity", "trace_id", "span_id", "request_id", "session_id")}
    version = get("schema_version")
    out = raw.select(*keep, doc.alias("_doc")).select(
        *keep, *(c.alias(k) for k, c in fields.items()), nanos(text("occurred_at")).alias("occurred_ns"), nanos(text("observed_at")).alias("observed_ns"), F.from_json(get("resource"), "map<string,string>").alias("resource"), get("payload").alias("payload"),
        F.when(F.col("_doc").isNull(), "invalid JSON").when(version.isNull() | ~version.rlike("^[0-9]+$"), "schema_version is missing").when(version != str(EVENT_VERSION), "unsupported schema_version").alias("_first"),
    )
    blank = lambda k: F.trim(F.coalesce(F.col(k), F.lit(""))) == ""
    reason = F.when(F.col("_first").isNotNull(), F.col("_first"))
    for k in ("event_id", "project", "environment"):
        reason = reason.when(blank(k), f"{k} is blank")
    reason = reason.when(~F.coalesce(F.col("signal"), F.lit("")).isin("log", "metric", "span"), "unknown signal").when(F.col("occurred_ns").isNull() | F.col("observed_ns").isNull(), "time is not RFC 3339").when(F.coalesce(F.size("resource"), F.lit(0)) <= 0, "resource is empty").when(F.coalesce(F.col("payload"), F.lit("null")) == "null", "payload is null")
    return out.withColumn("error", reason).drop("_first")
