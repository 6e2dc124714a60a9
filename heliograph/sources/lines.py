"""Line sources: container log frames, multi-line records, generic log formats, scraped metric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.values import json_at, json_text

FRAME = r"^(\S+) (stdout|stderr) ([FP]) (?s:(.*?))\r?\n?$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def nanos(text: Column) -> Column:
    """RFC 3339 time as nanoseconds since 1970; null if it is none. Keeps all nine digits."""
    whole = F.try_to_timestamp(F.regexp_replace(F.upper(F.regexp_replace(text, r"\.\d+", "")), "^(.{10}) ", "$1T"))
    part = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 9), 9, "0").try_cast("long")
    return F.when(text.rlike(RFC3339), F.unix_seconds(whole) * 1_000_000_000 + F.coalesce(part, F.lit(0)))


def frames(lines: DataFrame, column: str = "line") -> DataFrame:
    """Time, stream, whether a frame is full, and content; lines that are no frame have a null time."""
    part = lambda i: F.regexp_extract(F.col(column), FRAME, i)
    good = F.col(column).rlike(FRAME) & part(1).rlike(RFC3339)
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, F.when(good, part(1)).alias("time"), F.when(good, part(2)).alias("stream"), F.when(good, part(3) == "F").alias("full"), F.when(good, part(4)).alias("content"))


def _islands(rows: DataFrame, by: list[str], order: str, opens: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_island", F.sum(opens.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def reassemble(parts: DataFrame, by: list[str], order: str, *, most: int = 1 << 20) -> DataFrame:
    """Records of partial frames up to a full one, within a source and stream; over `most` bytes they are cut.

    A record's parts are a group of their own: islands between full frames.
    """
    w = Window.partitionBy(*by).orderBy(order)
    opens = F.coalesce(F.lag("full").over(w), F.lit(True))
    island = _islands(parts.withColumn("_opens", opens), by, order, F.col("_opens"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("content").alias("c")))), lambda x: x["c"]), "")
    out = island.groupBy(*by, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), joined.alias("content"), F.bool_or("full").alias("complete"), F.min("time").alias("time"))
    return out.drop("_island").withColumn("content", F.when(F.octet_length("content") <= most, F.col("content")).otherwise(F.substring("content", 1, most)))


def multiline(lines: DataFrame, by: list[str], order: str, start: str, *, column: str = "line", idle: int | None = None, time: str | None = None) -> DataFrame:
    """Records that begin where a line matches `start`, at a source's first line, or after `idle` time units of silence."""
    w = Window.partitionBy(*by).orderBy(order)
    opens = F.col(column).rlike(start) | F.lag(order).over(w).isNull()
    if idle is not None and time is not None:
        opens = opens | F.coalesce(F.col(time) - F.lag(time).over(w) > idle, F.lit(False))
    island = _islands(lines.withColumn("_opens", opens), by, order, F.col("_opens"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("c")))), lambda x: x["c"]), "\n")
    return island.groupBy(*by, "_island").agg(F.min(order).alias("first"), F.count("*").alias("lines"), joined.alias("record")).drop("_island")


def workload(path: Column) -> Column:
    """Namespace, pod, uid, container and restart of a pod-log path; null if it has another form."""
    form = r"(?:^|/)([^/_]+)_([^/_]+)_([^/]+)/([^/]+)/(\d+)\.log[^/]*$"
    names = ("namespace", "pod", "uid", "container")
    return F.when(path.rlike(form), F.struct(*(F.regexp_extract(path, form, i + 1).alias(n) for i, n in enumerate(names)), F.regexp_extract(path, form, 5).try_cast("long").alias("restart")))


def enriched(resource: Column, work: Column, labels: dict[str, str]) -> Column:
    """Resource attributes with the workload's identity and configured labels; configured ones win."""
    own = F.when(work.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("k8s.namespace.name"), work["namespace"], F.lit("k8s.pod.name"), work["pod"], F.lit("k8s.pod.uid"), work["uid"], F.lit("k8s.container.name"), work["container"]))
    extra = [x for kv in labels.items() for x in map(F.lit, kv)]
    last = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    keep = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    return keep(keep(resource, own), last)


def generic_logs(lines: DataFrame, form: str = "auto", column: str = "line") -> DataFrame:
    """message, severity, service, occurred_ns and document of log lines in `auto`, `json` or `text` form.

    auto takes what is no JSON as text; json marks it with an error.
    """
    if form not in ("auto", "json", "text"):
        raise ValueError("form is auto, json or text")
    raw = F.col(column)
    doc = F.to_json(F.try_parse_json(raw)) if form != "text" else F.lit(None).cast("string")
    text = lambda *names: F.coalesce(*(F.when(json_at(F.col("document"), [n]).startswith('"'), json_text(json_at(F.col("document"), [n]))) for n in names))
    out = lines.withColumn("document", doc)
    first = lambda a, b: F.when(json_at(F.col("document"), [a]).isNotNull(), text(a)).otherwise(text(b))
    nested = json_at(F.col("document"), ["service", "name"])
    service = F.coalesce(text("service"), F.when(nested.startswith('"'), json_text(nested)), F.lit("unknown"))
    return out.select(
        *lines.columns, F.coalesce(first("message", "msg"), F.regexp_replace(raw, r"[\r\n]+$", "")).alias("message"), F.upper(first("severity", "level")).alias("severity"), service.alias("service"),
        nanos(first("timestamp", "time")).alias("occurred_ns"), "document", F.when(F.lit(form == "json") & F.col("document").isNull(), "invalid JSON log").alias("error"),
    )


_NAME = "[A-Za-z_:][A-Za-z0-9_:]*"
_LABEL = r'\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*"(?:[^"\\]|\\[n"\\])*"\s*'
SAMPLE = rf"^({_NAME})(?:\{{((?:{_LABEL}(?:,{_LABEL})*+,?)?\s*)\}})?\s+(\S+)(?:\s+(-?\d+))?\s*$"


#: Kinds that a TYPE line may name: fixed values.
METRIC_KINDS = ("counter", "gauge", "histogram", "summary", "untyped", "unknown")


def scraped(lines: DataFrame, column: str = "line", by: str = "scrape") -> DataFrame:
    """Samples of metric text: name, labels, value, timestamp, whether it is a counter, or why the line is invalid.

    A name's TYPE comes from the lines of the same scrape; parts of a histogram count as counters.
    Samples of a family whose TYPE is repeated or unknown, and samples that repeat
    another one's name, labels and time, are invalid.
    """
    from heliograph.functions.values import identity

    raw = F.trim(F.col(column))
    types = lines.where(raw.rlike(r"^#\s*TYPE\s")).select(by, F.split(raw, r"\s+").alias("w")).select(by, F.element_at("w", -2).alias("family"), F.element_at("w", -1).alias("kind"))
    types = types.groupBy(by, "family").agg(F.min("kind").alias("kind"), F.when(F.count("*") > 1, "repeated TYPE").when(~F.min("kind").isin(*METRIC_KINDS), "invalid TYPE").alias("problem"))
    body = lines.where(raw.rlike(r"^[^#\s]")).withColumn("_raw", raw)
    part = lambda i: F.regexp_extract("_raw", SAMPLE, i)
    pairs = F.regexp_extract_all(part(2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\[n"\\])*)"'), 0)
    value = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r'^[^=]*=\s*"', ""), '"$', ""), r"\\\\", "\u0001"), r"\\n", "\n"), r'\\"', '"')
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^\s*([A-Za-z0-9_]+)", 1).alias("key"), F.regexp_replace(value(p), "\u0001", r"\\").alias("value"))))
    number = F.when(F.lower(part(3)).isin("nan", "+inf", "-inf", "inf"), F.lit(None)).otherwise(part(3)).try_cast("double")
    error = F.when(~F.col("_raw").rlike(SAMPLE), "invalid sample").when(number.isNull(), "invalid or non-finite number")
    rest = [c for c in lines.columns if c != column]
    samples = body.select(*rest, F.when(error.isNull(), part(1)).alias("name"), F.when(error.isNull(), labels).alias("labels"), F.when(error.isNull(), number).alias("value"), F.when(error.isNull() & (part(4) != ""), part(4).cast("long")).alias("timestamp"), error.alias("error"))
    root = F.regexp_replace("name", "_(?:bucket|count|sum)$", "")
    own = types.select(by, F.col("family").alias("name"), (F.col("kind") == "counter").alias("_own"), F.col("problem").alias("_own_problem"))
    parts = types.where("kind = 'histogram' OR problem IS NOT NULL").select(by, F.col("family").alias("_root"), (F.col("kind") == "histogram").alias("_part"), F.col("problem").alias("_part_problem"))
    out = samples.withColumn("_root", F.when(root != F.col("name"), root)).join(own, [by, "name"], "left").join(parts, [by, "_root"], "left")
    same = Window.partitionBy(by, "name", identity(F.col("labels")), "timestamp")
    again = F.when(F.col("name").isNotNull() & (F.count("*").over(same) > 1), "duplicate sample")
    out = out.withColumn("error", F.coalesce("error", "_own_problem", "_part_problem", again))
    return out.select(*rest, "name", "labels", "value", "timestamp", (F.coalesce("_own", F.lit(False)) | F.coalesce("_part", F.lit(False))).alias("counter"), "error")


def scraped_histogram_problem(samples: DataFrame, by: list[str]) -> DataFrame:
    """Histograms whose buckets fall, don't end with +Inf, or whose last bucket isn't their count."""
    le = F.try_element_at("labels", F.lit("le"))
    bound = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.try_cast("double"))
    from heliograph.functions.values import identity

    key = identity(F.map_filter("labels", lambda k, _: k != "le"))
    rows = samples.where(F.col("name").rlike("_(bucket|count)$")).select(*by, F.regexp_replace("name", "_(bucket|count)$", "").alias("family"), key.alias("key"), bound.alias("le"), "value", F.col("name").endswith("_count").alias("total"))
    w = Window.partitionBy(*by, "family", "key", "total").orderBy("le")
    fell = rows.withColumn("fell", ~F.col("total") & F.coalesce(F.lag("value").over(w) > F.col("value"), F.lit(False)))
    per = fell.groupBy(*by, "family", "key").agg(F.bool_or("fell").alias("fell"), F.max(F.when(~F.col("total"), F.col("le"))).alias("top"), F.max_by(F.when(~F.col("total"), F.col("value")), F.when(~F.col("total"), F.col("le"))).alias("last"), F.max(F.when(F.col("total"), F.col("value"))).alias("count"))
    why = F.when(F.col("fell"), "buckets fall").when(F.coalesce(F.col("top") != float("inf"), F.lit(True)), "no +Inf bucket").when(~F.col("last").eqNullSafe(F.col("count")), "last bucket is not the count")
    return per.withColumn("problem", why).where("problem IS NOT NULL").select(*by, "family", "key", "problem")


#: Levels of structured service logs: fixed values.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")


def service_logs(lines: DataFrame, schema: str, *, column: str = "line", keep: tuple[str, ...] = (), most_attributes: int = 64, most_key: int = 128, most_value: int = 4096, most_event: int = 65_536, most_request_id: int = 128) -> DataFrame:
    """Structured service logs under strict limits: the fields, and `error` where a rule is broken."""
    fields = "schema STRING, timestamp STRING, severity STRING, service STRUCT<name: STRING, version: STRING>, event STRING, message STRING, attributes MAP<STRING, STRING>, trace_id STRING, span_id STRING, parent_span_id STRING, trace_flags STRING, request_id STRING"
    raw = lines.select(*keep, F.from_json(column, fields).alias("x"), F.to_json(F.try_parse_json(F.col(column))).alias("_doc"))
    x = F.col("x")
    text = lambda c: F.coalesce(c, F.lit(""))
    bad_text = lambda c, most: (F.trim(text(c)) == "") | (F.octet_length(text(c)) > most)
    attributes = F.coalesce(x["attributes"], F.create_map().cast("map<string,string>"))
    # Values keep their JSON form in the document: nested ones begin with a bracket there.
    nested = F.exists(F.map_keys(attributes), lambda k: F.coalesce(F.try_element_at(F.from_json(json_at(F.col("_doc"), ["attributes"]), "map<string,string>"), k).rlike(r"^[\[{]"), F.lit(False)) & ~F.contains(F.col("_doc"), F.concat(F.lit('"'), k, F.lit('":"'))))
    hexes = lambda c, n, zero: c.isNotNull() & (~c.rlike(f"^[0-9a-f]{{{n}}}$") | (F.lit(not zero) & c.rlike("^0+$")))
    why = (
        F.when(F.col("_doc").isNull(), "invalid JSON")
        .when(text(x["schema"]) != schema, "unsupported schema")
        .when(nanos(text(x["timestamp"])).isNull(), "timestamp is not RFC 3339")
        .when(~text(x["severity"]).isin(*SEVERITIES), "unsupported severity")
        .when(bad_text(x["service"]["name"], most_event), "service.name is empty or too long")
        .when(bad_text(x["service"]["version"], most_event), "service.version is empty or too long")
        .when(bad_text(x["event"], most_event), "event is empty or too long")
        .when(F.octet_length(text(x["message"])) > most_value, "message is too long")
        .when(F.size(attributes) > most_attributes, "too many attributes")
        .when(F.exists(F.map_keys(attributes), lambda k: (F.trim(k) == "") | (F.octet_length(k) > most_key)), "attribute key is empty or too long")
        .when(nested, "attributes must be primitive")
        .when(F.exists(F.map_values(attributes), lambda v: F.octet_length(F.coalesce(v, F.lit(""))) > most_value), "attribute value is too long")
        .when(hexes(x["trace_id"], 32, False), "invalid trace_id")
        .when(hexes(x["span_id"], 16, False), "invalid span_id")
        .when(hexes(x["parent_span_id"], 16, False), "invalid parent_span_id")
        .when(hexes(x["trace_flags"], 2, True), "invalid trace_flags")
        .when(x["request_id"].isNotNull() & ((x["request_id"] == "") | (F.octet_length(x["request_id"]) > most_request_id) | x["request_id"].rlike(r"\p{Cntrl}")), "invalid request_id")
    )
    return raw.select(*keep, nanos(x["timestamp"]).alias("occurred_ns"), x["severity"].alias("severity"), x["service"]["name"].alias("service"), x["service"]["version"].alias("version"), x["event"].alias("event"), x["message"].alias("message"), attributes.alias("attributes"), x["trace_id"].alias("trace_id"), x["span_id"].alias("span_id"), x["request_id"].alias("request_id"), why.alias("error"))
