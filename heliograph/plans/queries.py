"""The registered queries of the telemetry operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.values import NANO
from heliograph.operators import alerts, correlate, errors, filters, ingest, logs, metrics, steps, store, traces
from heliograph.plans import promql
from heliograph.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: 2024-01-10 to 2024-01-20.
T0, T1 = 1_704_844_800 * NANO, 1_705_708_800 * NANO
SHOWN = ("cursor", "service", "environment", "severity", "trace_id")
SHOWN_SQL = ", ".join(SHOWN)
L = f"WITH {views.LOGS_SQL} "


def _filtered(tree: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: views.logs(spark, d).where(filters.compile_filter(tree, logs.document())).select(*SHOWN)


def _filter(name: str, tree: dict, where: str) -> None:
    query(name, L + f"SELECT {SHOWN_SQL} FROM logs WHERE {where}")(_filtered(tree))


@query("log_select_time", L + f"SELECT {SHOWN_SQL}, occurred_ns FROM logs WHERE severity = 'ERROR' AND occurred_ns >= {T0} AND occurred_ns < {T1} AND value > 10")
def _(spark, d):
    tree = {"op": "range", "field": "value", "gt": 10}
    some = logs.select(views.logs(spark, d), "demo", severity="error", start=T0, stop=T1)
    return some.where(filters.compile_filter(tree, logs.document())).select(*SHOWN, "occurred_ns")


_filter("filter_eq", {"op": "eq", "field": "service", "value": "purchase"}, "service = 'purchase'")
_filter("filter_eq_json", {"op": "eq", "field": "payload.k", "value": 7}, "CAST(json_extract(payload, '$.k') AS VARCHAR) = '7'")
_filter("filter_eq_type_mismatch", {"op": "eq", "field": "payload.k", "value": "7"}, "false")
_filter("filter_in", {"op": "in", "field": "trace_id", "values": ["1", "2", "3", "77"]}, "trace_id IN ('1', '2', '3', '77')")
_filter("filter_not_missing", {"op": "not", "arg": {"op": "eq", "field": "payload.absent", "value": 1}}, "true")
_filter("filter_exists", {"op": "and", "args": [{"op": "exists", "field": "payload.k"}, {"op": "not", "arg": {"op": "exists", "field": "payload.none"}}]}, "json_extract(payload, '$.k') IS NOT NULL AND json_extract(payload, '$.none') IS NULL")
_filter("filter_range_num", {"op": "range", "field": "payload.k", "gte": 10, "lt": 40.5}, "CAST(json_extract(payload, '$.k') AS DOUBLE) >= 10 AND CAST(json_extract(payload, '$.k') AS DOUBLE) < 40.5")
_filter("filter_range_str", {"op": "range", "field": "trace_id", "gt": "12", "lte": "7"}, "trace_id > '12' AND trace_id <= '7'")
_filter("filter_text", {"op": "text", "field": "body", "value": "USER 12"}, "contains(lower(body), 'user 12')")
_filter("filter_regex", {"op": "regex", "field": "body", "pattern": r"user \d+5 request \d*7$"}, r"regexp_matches(body, 'user \d+5 request \d*7$')")
_filter(
    "filter_nested_and_or",
    {"op": "or", "args": [{"op": "and", "args": [{"op": "eq", "field": "environment", "value": "prod"}, {"op": "range", "field": "value", "gt": 20}]}, {"op": "not", "arg": {"op": "in", "field": "service", "values": ["click", "view", "purchase"]}}]},
    "(environment = 'prod' AND value > 20) OR NOT service IN ('click', 'view', 'purchase')",
)


@query("log_text_all", "SELECT doc_id AS cursor, source AS service FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '\\s+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '\\s+'), 'license.')")
def _(spark, d):
    return logs.match_all(views.text_logs(spark, d), "The LICENSE. the").select("cursor", "service")


@query("log_page", L + f"SELECT {SHOWN_SQL}, true AS has_more FROM logs WHERE environment = 'prod' AND cursor > 500 ORDER BY cursor LIMIT 100")
def _(spark, d):
    return logs.page(logs.select(views.logs(spark, d), "demo", environment="prod"), 100, after=500).select(*SHOWN, "has_more")


@query("log_strict_page", L + f"SELECT * FROM (SELECT {SHOWN_SQL}, true AS has_more FROM logs WHERE cursor > 100 ORDER BY cursor LIMIT 200) WHERE service = 'error'")
def _(spark, d):
    return logs.strict_page(views.logs(spark, d), 200, {"op": "eq", "field": "service", "value": "error"}, after=100).select(*SHOWN, "has_more")


@query("log_count", L + f"SELECT count(*) AS n FROM logs WHERE occurred_ns >= {T0} AND occurred_ns < {T0 + logs.DAY_NS} AND service = 'click'")
def _(spark, d):
    return logs.count(views.logs(spark, d), T0, T0 + logs.DAY_NS, {"op": "eq", "field": "service", "value": "click"})


@query("log_retained", L + f"SELECT {SHOWN_SQL} FROM logs ORDER BY cursor DESC LIMIT 1000")
def _(spark, d):
    return logs.retained(views.logs(spark, d), 1000).select(*SHOWN)


# Metrics.
BY = ["service", "bucket"]
G = f"WITH {views.GAUGES_SQL} "
C = f"WITH {views.COUNTERS_SQL} "


def _aggregates(points: DataFrame, temporality: str) -> DataFrame:
    out = None
    for f in metrics.FUNCTIONS:
        part = metrics.aggregate(points, BY, temporality, f).select(*BY, F.lit(f).alias("function"), F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "metric_series_agg",
    G + """, s AS (SELECT service, bucket, arg_max(value, t) AS raw, sum(value) AS sum, avg(value) AS avg, min(value) AS min, max(value) AS max, CAST(count(*) AS DOUBLE) AS count,
arg_max(value, t) / ((max(t) - min(t)) / 1e9) AS rate FROM gauges WHERE NOT stale GROUP BY ALL)
SELECT service, bucket, function, round(value, 6) AS value FROM s UNPIVOT (value FOR function IN (raw, sum, avg, min, max, count, rate))""",
)
def _(spark, d):
    return _aggregates(views.gauges(spark, d), "gauge")


@query(
    "metric_semantic_total",
    C + """, st AS (SELECT *, lag(value) OVER (PARTITION BY service, bucket ORDER BY t, cursor) AS p FROM counters WHERE NOT stale)
SELECT service, bucket, round(sum(CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE greatest(value, 0) END), 6) AS total, CAST(count(*) FILTER (p IS NOT NULL AND value < p) AS BIGINT) AS resets FROM st GROUP BY ALL""",
)
def _(spark, d):
    return metrics.totals(views.counters(spark, d), BY, "cumulative").select(*BY, F.round("total", 6).alias("total"), "resets")


def _rollup(seconds: int) -> None:
    w = seconds * NANO

    @query(
        f"metric_rollup_{seconds}s",
        G + f"""SELECT service, bucket, t - t % {w} AS window_start, count(*) AS point_count, round(sum(value), 6) AS sum, round(min(value), 6) AS min, round(max(value), 6) AS max, round(arg_max(value, t), 6) AS last
FROM gauges WHERE NOT stale GROUP BY ALL""",
    )
    def _(spark, d):
        return metrics.rollup(views.gauges(spark, d), BY, seconds).select(*BY, "window_start", "point_count", *(F.round(c, 6).alias(c) for c in ("sum", "min", "max", "last")))


for _seconds in metrics.ROLLUP_SECONDS:
    _rollup(_seconds)


@query(
    "metric_rollup_exemplars",
    G + f"""SELECT service, window_start, string_agg(trace_id, ',' ORDER BY trace_id) AS exemplars FROM (SELECT DISTINCT service, t - t % {3600 * NANO} AS window_start, trace_id FROM gauges WHERE NOT stale) GROUP BY ALL""",
)
def _(spark, d):
    points = views.gauges(spark, d).withColumn("exemplars", F.array(F.struct("trace_id", F.lit("").alias("span_id"))))
    return metrics.rollup_exemplars(points, ["service"], 3600).select("service", "window_start", F.array_join(F.transform("exemplars", lambda e: e["trace_id"]), ",").alias("exemplars"))


@query("metric_series_id", G + "SELECT DISTINCT service, bucket, sha256('[\"demo\",\"value\",\"' || service || '\",\"' || bucket || '\"]') AS series_id FROM gauges")
def _(spark, d):
    return views.gauges(spark, d).select(*BY, metrics.series_id(F.col("project"), F.col("name"), F.col("service"), F.col("bucket")).alias("series_id")).distinct()


@query(
    "metric_overflow",
    G + """, f AS (SELECT service, trace_id, min(cursor) AS first FROM gauges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY first) > 50 AS overflow FROM f)
SELECT service, overflow, count(*) AS points, count(DISTINCT trace_id) AS series FROM gauges JOIN r USING (service, trace_id) GROUP BY ALL""",
)
def _(spark, d):
    marked = metrics.limit_cardinality(views.gauges(spark, d), ["trace_id"], ["service"], 50)
    per = marked.groupBy("service", "overflow", "trace_id").agg(F.count("*").alias("n"))
    return per.groupBy("service", "overflow").agg(F.sum("n").alias("points"), F.count("*").alias("series"))


@query(
    "metric_overflow_fold",
    G + """, f AS (SELECT service, trace_id, min(cursor) AS first FROM gauges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY first) > 50 AS overflow FROM f)
SELECT service, CASE WHEN overflow THEN 'overflow' ELSE trace_id END AS series, overflow, count(*) AS points, min(cursor) AS first_cursor, max(cursor) AS last_cursor FROM gauges JOIN r USING (service, trace_id) GROUP BY ALL""",
)
def _(spark, d):
    folded = metrics.fold_overflow(views.gauges(spark, d), ["trace_id"], ["service"], 50)
    per = folded.groupBy("service", "trace_id", "overflow").agg(F.count("*").alias("points"), F.min("cursor").alias("first_cursor"), F.max("cursor").alias("last_cursor"))
    return per.select("service", F.coalesce("trace_id", F.lit("overflow")).alias("series"), "overflow", "points", "first_cursor", "last_cursor")


@query("metric_select", G + f"SELECT service, bucket, cursor, stale FROM gauges WHERE service = 'view' AND bucket = '1' AND t >= {100 * NANO} AND t < {2000 * NANO}")
def _(spark, d):
    g = views.gauges(spark, d)
    return g.where((F.col("service") == "view") & (F.col("bucket") == "1") & (F.col("t") >= 100 * NANO) & (F.col("t") < 2000 * NANO)).select(*BY, "cursor", "stale")


@query("metric_newest_points", G + "SELECT service, bucket, cursor FROM gauges QUALIFY row_number() OVER (PARTITION BY service, bucket ORDER BY t DESC, cursor DESC) <= 10")
def _(spark, d):
    return metrics.newest_points(views.gauges(spark, d), BY, 10).select(*BY, "cursor")


@query("metric_series_page", G + "SELECT series_id, count(*) AS points FROM (SELECT service || '/' || bucket AS series_id FROM gauges) WHERE series_id > 'click/1' GROUP BY ALL ORDER BY series_id LIMIT 6")
def _(spark, d):
    per = views.gauges(spark, d).groupBy(F.concat_ws("/", *BY).alias("series_id")).agg(F.count("*").alias("points"))
    return metrics.series_page(per, 5, after="click/1")


H = f"WITH {views.HISTOGRAMS_SQL} "


@query(
    "histogram_merge",
    H + """SELECT series, CAST(sum(c0) AS VARCHAR) || ',' || CAST(sum(c1) AS VARCHAR) || ',' || CAST(sum(c2) AS VARCHAR) || ',' || CAST(sum(c3) AS VARCHAR) || ',' || CAST(sum(c4) AS VARCHAR) AS counts,
CAST(sum(count) AS BIGINT) AS count, round(sum(sum), 3) AS sum, min(min) AS min, max(max) AS max FROM histograms GROUP BY series""",
)
def _(spark, d):
    out = metrics.merge_histograms(views.histograms(spark, d), ["series"], len(views.BOUNDS))
    return out.select("series", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), "count", F.round("sum", 3).alias("sum"), "min", "max")


@query(
    "histogram_to_classic",
    H + """, m AS (SELECT series, sum(c0) c0, sum(c1) c1, sum(c2) c2, sum(c3) c3, sum(c4) c4, sum(count) AS n, sum(sum) AS s FROM histograms GROUP BY series), x AS (
SELECT series, 'bucket' AS kind, '10' AS le, c0 AS value FROM m UNION ALL SELECT series, 'bucket', '20', c0 + c1 FROM m UNION ALL SELECT series, 'bucket', '30', c0 + c1 + c2 FROM m UNION ALL SELECT series, 'bucket', '40', c0 + c1 + c2 + c3 FROM m
UNION ALL SELECT series, 'bucket', '+Inf', c0 + c1 + c2 + c3 + c4 FROM m UNION ALL SELECT series, 'count', '', n FROM m UNION ALL SELECT series, 'sum', '', s FROM m) SELECT series, kind, le, round(CAST(value AS DOUBLE), 3) AS value FROM x""",
)
def _(spark, d):
    merged = metrics.merge_histograms(views.histograms(spark, d), ["series"], len(views.BOUNDS))
    return metrics.to_classic(merged, ["series"], list(views.BOUNDS)).withColumn("value", F.round("value", 3))


# Steps: 120 steps of 30 s from 600 s on compressed time.
START, STEP, COUNT = 600 * NANO, 30 * NANO, 120
STEPS_SQL = f"steps AS (SELECT k, {START} + k * {STEP} AS s FROM (SELECT unnest(range(0, {COUNT})) AS k))"
LOOK = steps.LOOKBACK


def _instant_sql(edge: str) -> str:
    return f"""vis AS (SELECT service, bucket, k, arg_max(value, (t, cursor)) AS value, arg_max(stale, (t, cursor)) AS stale, max(t) AS t, any_value(s) AS s FROM steps JOIN gauges ON t <= s GROUP BY service, bucket, k),
seen AS (SELECT service, bucket, k, value FROM vis WHERE NOT stale AND s - t {edge} {LOOK})"""


@query("prom_instant", G + ", " + _instant_sql("<").replace("steps JOIN", f"(SELECT 0 AS k, {1500 * NANO} AS s) JOIN") + " SELECT service, bucket, round(value, 6) AS value FROM seen")
def _(spark, d):
    return steps.instant(views.gauges(spark, d), BY, 1500 * NANO, NANO, 1, closed=False).select(*BY, F.round("value", 6).alias("value"))


@query("prom_range", G + f", {STEPS_SQL}, {_instant_sql('<')} SELECT service, bucket, k, round(value, 6) AS value FROM seen")
def _(spark, d):
    return steps.instant(views.gauges(spark, d), BY, START, STEP, COUNT, closed=False).select(*BY, "k", F.round("value", 6).alias("value"))


@query(
    "prom_sum_range",
    G + f", {STEPS_SQL}, {_instant_sql('<')} SELECT k, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS count FROM seen GROUP BY k",
)
def _(spark, d):
    seen = steps.instant(views.gauges(spark, d), BY, START, STEP, COUNT, closed=False)
    return seen.groupBy("k").agg(*(F.round(f("value"), 6).alias(n) for n, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))), F.count("*").alias("count"))


@query(
    "prom_rate_v1",
    C + f""", {STEPS_SQL}, e AS (SELECT *, sum(stale::INT) OVER (PARTITION BY service, bucket ORDER BY t ROWS UNBOUNDED PRECEDING) AS epoch FROM counters),
i AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE greatest(value, 0) END AS up FROM e WHERE NOT stale WINDOW w AS (PARTITION BY service, bucket, epoch ORDER BY t)),
r AS (SELECT *, sum(up) OVER (PARTITION BY service, bucket, epoch ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM i),
cur AS (SELECT service, bucket, k, s, max(epoch) AS epoch FROM steps JOIN e ON t <= s GROUP BY ALL),
p AS (SELECT c.service, c.bucket, c.k, min(r.t) AS a, max(r.t) AS b, arg_min(r.run, r.t) AS ra, arg_max(r.run, r.t) AS rb FROM cur c JOIN r ON r.service = c.service AND r.bucket = c.bucket AND r.epoch = c.epoch AND r.t <= c.s AND r.t > c.s - {LOOK} GROUP BY ALL)
SELECT service, bucket, k, round((rb - ra) / ((b - a) / 1e9), 6) AS value FROM p WHERE b > a""",
)
def _(spark, d):
    return steps.simple_rate(views.counters(spark, d), BY, START, STEP, COUNT).select(*BY, "k", F.round("value", 6).alias("value"))


# Expressions.
def _labelled(df: DataFrame, name: str | None = None) -> DataFrame:
    out = df.withColumn("labels", F.create_map(F.lit("bucket"), F.col("bucket"), F.lit("service"), F.col("service")))
    return out if name is None else out.withColumn("name", F.lit(name))


def _all_points(spark, d) -> DataFrame:
    keep = ["name", "labels", "t", "cursor", "value", "stale"]
    return _labelled(views.gauges(spark, d)).select(*keep).unionByName(_labelled(views.counters(spark, d)).select(*keep))


def _expression(name: str, text: str, sql: str, labels: tuple[str, ...], grid: promql.Grid = promql.Grid(START, STEP, COUNT), points=_all_points) -> None:
    def run(spark, d):
        out = promql.evaluate(text, points(spark, d), grid)
        return out.select("k", *(F.try_element_at("labels", F.lit(x)).alias(x.strip("_")) for x in labels), F.round("value", 6).alias("value"))

    query(name, sql)(run)


INSTANT = G + f", {STEPS_SQL}, {_instant_sql('<=')} "
WINDOW = 300 * NANO


def _change_sql(table: str = "counters", by: str = "service, bucket", window: int = WINDOW) -> str:
    return f"""live AS (SELECT *, lag(value) OVER (PARTITION BY {by} ORDER BY t, cursor) AS pv FROM {table} WHERE NOT stale),
adj AS (SELECT *, sum(CASE WHEN value < pv THEN pv ELSE 0 END) OVER (PARTITION BY {by} ORDER BY t, cursor ROWS UNBOUNDED PRECEDING) AS shift FROM live),
win AS (SELECT {by}, k, any_value(s) AS s, count(*) AS n, min(t) AS ta, max(t) AS tb, arg_min(value, t) AS va, arg_max(value, t) AS vb, arg_min(shift, t) AS sa, arg_max(shift, t) AS sb FROM steps JOIN adj ON t > s - {window} AND t <= s GROUP BY {by}, k HAVING count(*) >= 2),
raw AS (SELECT *, (vb + sb) - (va + sa) AS change, (tb - ta) / 1e9 AS sampled, (ta - (s - {window})) / 1e9 AS before0, (s - tb) / 1e9 AS after FROM win),
cut AS (SELECT *, sampled / (n - 1) AS spacing, CASE WHEN change > 0 AND va >= 0 THEN least(before0, sampled * va / change) ELSE before0 END AS before FROM raw),
inc AS (SELECT {by}, k, change * (sampled + CASE WHEN before >= spacing * 1.1 THEN spacing / 2 ELSE before END + CASE WHEN after >= spacing * 1.1 THEN spacing / 2 ELSE after END) / sampled AS v FROM cut)"""


CHANGE = C + f", {STEPS_SQL}, {_change_sql()} "
S, SB = ("service",), ("service", "bucket")
_expression("promql_increase", "increase(value_total[5m])", CHANGE + "SELECT k, service, bucket, round(v, 6) AS value FROM inc", SB)
_expression("promql_rate", "rate(value_total[5m])", CHANGE + "SELECT k, service, bucket, round(v / 300, 6) AS value FROM inc", SB)
_expression("promql_sum_by", "sum by (service) (rate(value_total[5m]))", CHANGE + "SELECT k, service, round(sum(v / 300), 6) AS value FROM inc GROUP BY ALL", S)
_expression("promql_without", "max without (bucket) (value)", INSTANT + "SELECT k, service, round(max(value), 6) AS value FROM seen GROUP BY ALL", S)
_expression("promql_count", "count(value)", INSTANT + "SELECT k, round(CAST(count(*) AS DOUBLE), 6) AS value FROM seen GROUP BY ALL", ())
_expression("promql_selector", "value", INSTANT + "SELECT k, 'value' AS name, service, bucket, round(value, 6) AS value FROM seen", ("__name__", *SB))
_expression("promql_vector_scalar", "value * 100 - 5", INSTANT + "SELECT k, service, bucket, round(value * 100 - 5, 6) AS value FROM seen", SB)
_expression("promql_unary", "-value", INSTANT + "SELECT k, service, bucket, round(-value, 6) AS value FROM seen", SB)
_expression("promql_compare_filter", "value > 20", INSTANT + "SELECT k, 'value' AS name, service, bucket, round(value, 6) AS value FROM seen WHERE value > 20", ("__name__", *SB))
_expression("promql_compare_scalar_left", "10 < value * 2", INSTANT + "SELECT k, service, bucket, round(value * 2, 6) AS value FROM seen WHERE 10 < value * 2", SB)
_expression("promql_compare_bool", "value >= bool 10", INSTANT + "SELECT k, service, bucket, round(CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS value FROM seen", SB)
_expression("promql_matchers", 'value{service=~"cl.*|view",bucket!="2",zone=""}', INSTANT + "SELECT k, service, bucket, round(value, 6) AS value FROM seen WHERE regexp_full_match(service, 'cl.*|view') AND bucket <> '2'", SB)
_expression("promql_matchers_not", 'value{service!~"cl.*",bucket="1"}', INSTANT + "SELECT k, service, bucket, round(value, 6) AS value FROM seen WHERE NOT regexp_full_match(service, 'cl.*') AND bucket = '1'", SB)
_expression(
    "promql_ratio_on", 'sum by (service) (value) / on (service) count by (service) (value)',
    INSTANT + "SELECT k, service, round(sum(value) / count(*), 6) AS value FROM seen GROUP BY ALL", S,
)
_expression(
    "promql_ignoring", 'value{bucket="1"} + ignoring(bucket) value{bucket="2"}',
    INSTANT + "SELECT a.k, a.service, round(a.value + b.value, 6) AS value FROM seen a JOIN seen b ON a.k = b.k AND a.service = b.service AND a.bucket = '1' AND b.bucket = '2'", S,
)
_expression("promql_vector_compare", "value > ignoring() value * 0.5", INSTANT + "SELECT k, service, bucket, round(value, 6) AS value FROM seen WHERE value > value * 0.5", SB)


def _quantity_buckets(spark, d) -> DataFrame:
    """Cumulative bucket counters a return flag; a point a ship day, on compressed time of a day a second."""
    from pyspark.sql import Window

    rows = metrics.to_classic(views.histograms(spark, d), ["series", "t"], list(views.BOUNDS)).where("kind = 'bucket'")
    run = Window.partitionBy("series", "le").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    day = F.expr(f"t div {86_400 * NANO}")
    labels = F.create_map(F.lit("flag"), F.col("series"), F.lit("le"), F.col("le"))
    return rows.select(F.lit("quantity_bucket").alias("name"), labels.alias("labels"), (day * NANO).alias("t"), day.alias("cursor"), F.sum("value").over(run).alias("value"), F.lit(False).alias("stale"))


DAY0 = 8_035 + 365 * 2  # two years after 1992-01-01
HIST_GRID = promql.Grid(DAY0 * NANO, 30 * NANO, 40)
_expression(
    "promql_histogram_quantile", "histogram_quantile(0.9, sum by (flag, le) (increase(quantity_bucket[5m])))",
    H + f""", x AS (SELECT series AS flag, t, '10' AS le, c0 AS v FROM histograms UNION ALL SELECT series, t, '20', c0 + c1 FROM histograms UNION ALL SELECT series, t, '30', c0 + c1 + c2 FROM histograms UNION ALL SELECT series, t, '40', c0 + c1 + c2 + c3 FROM histograms UNION ALL SELECT series, t, '+Inf', count FROM histograms),
points AS (SELECT flag, le, t // {86_400 * NANO} * {NANO} AS t, t // {86_400 * NANO} AS cursor, CAST(sum(v) OVER (PARTITION BY flag, le ORDER BY t ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value, false AS stale FROM x),
steps AS (SELECT k, {DAY0 * NANO} + k * {30 * NANO} AS s FROM (SELECT unnest(range(0, 40)) AS k)), {_change_sql("points", "flag, le")},
b AS (SELECT k, flag, CASE le WHEN '+Inf' THEN 1e308 ELSE CAST(le AS DOUBLE) END AS le, v FROM inc),
m AS (SELECT *, max(v) OVER (PARTITION BY k, flag ORDER BY le ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY k, flag ORDER BY le) AS i, count(*) OVER (PARTITION BY k, flag) AS n FROM b),
p AS (SELECT *, lag(c) OVER (PARTITION BY k, flag ORDER BY le) AS pc, lag(le) OVER (PARTITION BY k, flag ORDER BY le) AS ple, max(c) OVER (PARTITION BY k, flag) * 0.9 AS rank, max(c) OVER (PARTITION BY k, flag) AS total FROM m),
h AS (SELECT * FROM p WHERE (i < n AND c >= rank) OR i = n QUALIFY row_number() OVER (PARTITION BY k, flag ORDER BY i) = 1)
SELECT k, flag, round(CASE WHEN total <= 0 THEN 'nan'::DOUBLE WHEN i = n THEN ple ELSE coalesce(ple, 0) + (le - coalesce(ple, 0)) * (rank - coalesce(pc, 0)) / (c - coalesce(pc, 0)) END, 6) AS value FROM h""",
    ("flag",), HIST_GRID, _quantity_buckets,
)


# Traces.
T = f"WITH {views.SPANS_SQL}, latest AS (SELECT *, count(*) OVER (PARTITION BY trace_id, span_id) > 1 AS conflict FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY cursor DESC) = 1) "
TP = T + ", par AS (SELECT l.*, l.parent_id IS NOT NULL AND p.span_id IS NULL AS missing, l.parent_id IS NULL OR p.span_id IS NULL AS root FROM latest l LEFT JOIN latest p ON l.trace_id = p.trace_id AND l.parent_id = p.span_id) "


def _spans(spark, d) -> DataFrame:
    return traces.latest(traces.valid(views.spans(spark, d)))


@query("trace_latest_span", T + "SELECT trace_id, span_id, parent_id, start, stop, operation, cursor, conflict FROM latest")
def _(spark, d):
    return _spans(spark, d).select("trace_id", "span_id", "parent_id", "start", "stop", "operation", "cursor", "conflict")


@query("trace_retention", T + ", kept AS (SELECT * FROM spans QUALIFY rank() OVER (ORDER BY cursor DESC) <= 500) SELECT trace_id, span_id, max(cursor) AS cursor, count(*) > 1 AS conflict FROM kept GROUP BY ALL")
def _(spark, d):
    return traces.latest(traces.newest(traces.valid(views.spans(spark, d)), 500)).select("trace_id", "span_id", "cursor", "conflict")


@query(
    "trace_summary",
    TP + """SELECT trace_id, count(*) AS n_spans, max(stop) - min(start) AS duration, coalesce(string_agg(span_id, ',' ORDER BY span_id) FILTER (root), '') AS roots, CAST(count(*) FILTER (missing) AS BIGINT) AS missing,
CAST(count(*) FILTER (conflict) AS BIGINT) AS conflicts, bool_or(missing OR conflict) OR NOT bool_or(root) AS partial FROM par GROUP BY trace_id""",
)
def _(spark, d):
    return traces.summary(traces.with_parents(_spans(spark, d))).drop("project")


@query("trace_gaps_roots", TP + "SELECT trace_id, 'missing_parent:' || span_id || ':' || parent_id AS gap FROM par WHERE missing UNION ALL SELECT trace_id, 'conflicting_span:' || span_id FROM par WHERE conflict")
def _(spark, d):
    return traces.gaps(traces.with_parents(_spans(spark, d))).drop("project")


PATH_SQL = T.replace("WITH ", "WITH RECURSIVE ", 1) + """, par AS (SELECT l.*, p.span_id IS NULL AS root FROM latest l LEFT JOIN latest p ON l.trace_id = p.trace_id AND l.parent_id = p.span_id),
walk AS (SELECT trace_id, span_id AS tip, [span_id] AS path, stop - start AS length FROM par WHERE root UNION ALL SELECT w.trace_id, c.span_id, list_append(w.path, c.span_id), w.length + c.stop - c.start FROM walk w JOIN par c ON c.trace_id = w.trace_id AND c.parent_id = w.tip AND NOT c.root)
SELECT trace_id, array_to_string(path, '>') AS path, length FROM walk QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY length DESC, path) = 1"""


@query("trace_critical_path", PATH_SQL)
def _(spark, d):
    return traces.critical_path(_spans(spark, d)).select("trace_id", F.array_join("path", ">").alias("path"), "length")


# Traces of forty levels over the events: a third with a root, a third with a cycle at the top, a third under an absent parent.
DEEP = """WITH RECURSIVE deep AS (SELECT event_id // 40 AS t, event_id % 40 AS i, CASE WHEN event_id % 40 = 0 THEN (CASE event_id // 40 % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE 99 END) WHEN event_id % 10 = 5 THEN event_id % 40 - 3 ELSE event_id % 40 - 1 END AS up,
CAST(abs(user_id) % 50 AS BIGINT) AS own FROM events), named AS (SELECT lpad(CAST(t AS VARCHAR), 6, '0') AS trace_id, lpad(CAST(i AS VARCHAR), 2, '0') AS span_id, lpad(CAST(up AS VARCHAR), 2, '0') AS parent_id, own FROM deep),
par AS (SELECT a.*, b.span_id IS NULL AS root, bool_or(b.span_id IS NULL) OVER (PARTITION BY a.trace_id) AS rooted FROM named a LEFT JOIN named b ON a.trace_id = b.trace_id AND a.parent_id = b.span_id), """


def _deep(spark, d) -> DataFrame:
    e = views.table(spark, d, "events").selectExpr("event_id div 40 AS t", "event_id % 40 AS i", "abs(user_id) % 50 AS own")
    up = F.expr("CASE WHEN i = 0 THEN (CASE t % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE 99 END) WHEN i % 10 = 5 THEN i - 3 ELSE i - 1 END")
    name = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return e.select(F.lit("demo").alias("project"), name(F.col("t"), 6).alias("trace_id"), name(F.col("i"), 2).alias("span_id"), name(up, 2).alias("parent_id"), F.lit(0).cast("long").alias("start"), F.col("own").cast("long").alias("stop"))


@query("trace_critical_path_deep", DEEP + """walk AS (SELECT trace_id, span_id AS tip, [span_id] AS path, own AS length FROM par WHERE root OR NOT rooted UNION ALL SELECT w.trace_id, c.span_id, list_append(w.path, c.span_id), w.length + c.own FROM walk w JOIN par c ON c.trace_id = w.trace_id AND c.parent_id = w.tip AND NOT list_contains(w.path, c.span_id)),
leaf AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM par c WHERE c.trace_id = w.trace_id AND c.parent_id = w.tip AND NOT list_contains(w.path, c.span_id)))
SELECT trace_id, array_to_string(path, '>') AS path, length FROM leaf QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY length DESC, path) = 1""")  # fmt: skip
def _(spark, d):
    return traces.critical_path(_deep(spark, d)).select("trace_id", F.array_join("path", ">").alias("path"), "length")


@query("trace_cycles", DEEP + """walk AS (SELECT trace_id, span_id AS start, parent_id AS above, 1 AS n FROM par UNION ALL SELECT w.trace_id, w.start, p.parent_id, w.n + 1 FROM walk w JOIN par p ON p.trace_id = w.trace_id AND p.span_id = w.above WHERE w.n < 41 AND w.above <> w.start),
member AS (SELECT DISTINCT trace_id, start FROM walk WHERE above = start), ring AS (SELECT m.trace_id, m.start, min(w.above) AS least FROM member m JOIN walk w USING (trace_id, start) GROUP BY ALL)
SELECT trace_id, string_agg(start, ',' ORDER BY start) AS cycle FROM ring GROUP BY trace_id, least""")  # fmt: skip
def _(spark, d):
    return traces.cycles(traces.with_parents(_deep(spark, d))).select("trace_id", F.array_join("cycle", ",").alias("cycle"))


@query("trace_correlation_ids", T + """SELECT trace_id, 'span_id' AS kind, string_agg(span_id, ',' ORDER BY span_id) AS ids FROM (SELECT DISTINCT trace_id, span_id FROM latest) GROUP BY ALL
UNION ALL SELECT trace_id, 'operation', string_agg(operation, ',' ORDER BY operation) FROM (SELECT DISTINCT trace_id, operation FROM latest) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return traces.correlation_ids(_spans(spark, d), ("span_id", "operation")).drop("project")


@query("trace_search", T + """SELECT trace_id, max(stop) - min(start) AS duration, count(*) AS n_spans FROM latest GROUP BY trace_id
HAVING bool_or(stop >= 5 AND start < 40 AND service = 'R') AND bool_or(stop >= 5 AND start < 40 AND operation = 'part-3') AND bool_or(stop >= 5 AND start < 40 AND lower(status) = 'f') AND max(stop) - min(start) BETWEEN 10 AND 48""")  # fmt: skip
def _(spark, d):
    return traces.search(_spans(spark, d), service="R", operation="part-3", status="f", start=5, stop=40, least=10, most=48).drop("project")


@query("trace_page", T + "SELECT trace_id, count(*) AS n_spans FROM latest WHERE trace_id > '2' GROUP BY trace_id ORDER BY trace_id LIMIT 51")
def _(spark, d):
    per = _spans(spark, d).groupBy("trace_id").agg(F.count("*").alias("n_spans"))
    return metrics.series_page(per, 50, after="2", key="trace_id")


@query("trace_get", T + "SELECT span_id, parent_id, start, stop FROM latest WHERE trace_id = '7'")
def _(spark, d):
    return traces.latest(traces.valid(views.spans(spark, d).where("trace_id = '7'"))).select("span_id", "parent_id", "start", "stop")


# Across signals.
def _exemplars(spark, d) -> DataFrame:
    return views.gauges(spark, d).withColumn("exemplars", F.array(F.struct("value", "trace_id", F.col("cursor").cast("string").alias("span_id"))))


@query("correlate_logs", L + f"SELECT {SHOWN_SQL} FROM logs WHERE trace_id = '12' AND service = 'click'")
def _(spark, d):
    correlate.check(trace_id="12", service="click")
    return logs.select(views.logs(spark, d), "demo", trace_id="12", service="click").select(*SHOWN)


@query("correlate_metrics_exemplar", G + "SELECT DISTINCT service, bucket FROM gauges WHERE trace_id = '12'")
def _(spark, d):
    return correlate.series_with_exemplar(_exemplars(spark, d), BY, trace_id="12")


@query("correlate_metrics_of_errors", G + "SELECT DISTINCT service, bucket FROM gauges WHERE trace_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND value > 20)")
def _(spark, d):
    return correlate.metrics_of_traces(_exemplars(spark, d), views.logs(spark, d).where("severity = 'ERROR' AND value > 20"), BY)


@query("correlate_traces", T + "SELECT DISTINCT trace_id FROM latest WHERE span_id = '7'")
def _(spark, d):
    return correlate.traces_with_span(_spans(spark, d), "7").select("trace_id")


@query(
    "service_list",
    f"WITH {views.LOGS_SQL}, {views.GAUGES_SQL}" + """, a AS (SELECT service, environment, 'v' || (CAST(trace_id AS BIGINT) % 3) AS version, 'log' AS signal FROM logs UNION ALL SELECT service, 'prod', 'v9', 'metric' FROM gauges WHERE bucket = '1')
SELECT service, array_to_string(list_sort(list(DISTINCT environment)), ',') AS environments, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM a GROUP BY service""",
)
def _(spark, d):
    a = views.logs(spark, d).withColumn("version", F.concat(F.lit("v"), (F.col("trace_id").cast("long") % 3).cast("string")))
    b = views.gauges(spark, d).where("bucket = '1'").select("service", F.lit("prod").alias("environment"), F.lit("v9").alias("version"))
    return correlate.services(("log", a), ("metric", b))


# Errors and alerts.
VOLATILE_SQL = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b0x[0-9a-f]+\b|\b\d+(?:\.\d+)?\b"
PRINT_SQL = rf"trim(regexp_replace(regexp_replace(body, '{VOLATILE_SQL}', '?', 'g'), '\s+', ' ', 'g'))"
ERR = L + f", err AS (SELECT *, {PRINT_SQL} AS fingerprint FROM logs WHERE severity = 'ERROR'), ids AS (SELECT *, sha256('[\"demo\",\"' || environment || '\",\"' || service || '\",\"log_error\",\"' || fingerprint || '\"]') AS group_id FROM err) "


# Word boundaries of all scripts, which the SQL engine's patterns don't know: tests compare it with a plain form.
@query("error_fingerprint")
def _(spark, d):
    return views.text_logs(spark, d).select(F.col("cursor").alias("doc_id"), errors.fingerprint(F.col("body")).alias("fingerprint"))


@query("error_groups", ERR + """SELECT group_id, environment, service, fingerprint, count(*) AS count, min(occurred_ns) AS first_seen, max(occurred_ns) AS last_seen, min(cursor) AS first_cursor, max(cursor) AS last_cursor,
array_to_string(list_reverse((list(cursor ORDER BY cursor DESC))[1:3]), ',') AS samples FROM ids GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    out = errors.groups(errors.classified(views.logs(spark, d)))
    return out.select("group_id", "environment", "service", "fingerprint", "count", "first_seen", "last_seen", "first_cursor", "last_cursor", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("error_versions", ERR + """, f AS (SELECT group_id, trace_id AS version, min(cursor) AS first FROM ids GROUP BY ALL), v AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY first, version) <= 100)
SELECT group_id, string_agg(version, ',' ORDER BY version) AS versions FROM v GROUP BY 1""")  # fmt: skip
def _(spark, d):
    found = errors.versions(errors.classified(views.logs(spark, d)), F.col("trace_id"))
    return found.select("group_id", F.array_join("versions", ",").alias("versions"))


@query("error_feed", ERR + ", page AS (SELECT max(cursor) AS until FROM (SELECT cursor FROM logs WHERE cursor > 250 ORDER BY cursor LIMIT 500)) SELECT cursor, group_id, fingerprint, until FROM ids, page WHERE cursor > 250 AND cursor <= until")
def _(spark, d):
    page, until = errors.feed(views.logs(spark, d), 250)
    return page.select("cursor", "group_id", "fingerprint", F.lit(until).cast("long").alias("until"))


@query("error_recurrence", ERR + """, ch AS (SELECT group_id, min(cursor) + 1000 AS cursor, 'resolved' AS what FROM ids GROUP BY 1), u AS (SELECT group_id, cursor, 'seen' AS what FROM ids UNION ALL SELECT * FROM ch),
o AS (SELECT *, lag(what) OVER (PARTITION BY group_id ORDER BY cursor, CASE WHEN what = 'seen' THEN 1 ELSE 0 END) AS before FROM u)
SELECT group_id, CASE WHEN arg_max(what, cursor * 2 + CASE WHEN what = 'seen' THEN 1 ELSE 0 END) = 'seen' THEN 'open' ELSE 'resolved' END AS status, CAST(count(*) FILTER (what = 'seen' AND before = 'resolved') AS BIGINT) AS recurrence_count, coalesce(max(cursor) FILTER (what = 'seen' AND before = 'resolved'), -1) AS recurrence_cursor FROM o GROUP BY group_id""")  # fmt: skip
def _(spark, d):
    found = errors.classified(views.logs(spark, d))
    changes = found.groupBy("group_id").agg((F.min("cursor") + 1000).alias("cursor")).withColumn("status", F.lit("resolved"))
    return errors.recurrence(found, changes).withColumn("recurrence_cursor", F.coalesce("recurrence_cursor", F.lit(-1)))


@query("alert_condition", G + "SELECT service, bucket, round(avg(value), 6) AS value, avg(value) > 12.5 AS firing FROM gauges WHERE NOT stale GROUP BY ALL")
def _(spark, d):
    out = metrics.aggregate(views.gauges(spark, d), BY, "gauge", "avg")
    return out.select(*BY, F.round("value", 6).alias("value"), alerts.condition(F.col("value"), "greater", 12.5).alias("firing"))


@query("alert_no_data", G + f", known AS (SELECT DISTINCT service, bucket FROM gauges), obs AS (SELECT service, bucket, 'condition' AS kind, max(value) > 20 AS truth FROM gauges WHERE t >= {900 * NANO} AND t < {990 * NANO} GROUP BY ALL) SELECT * FROM obs UNION ALL SELECT service, bucket, 'no_data', false FROM known ANTI JOIN obs USING (service, bucket)")
def _(spark, d):
    g = views.gauges(spark, d)
    recent = g.where((F.col("t") >= 900 * NANO) & (F.col("t") < 990 * NANO)).groupBy(*BY).agg(F.lit("condition").alias("kind"), (F.max("value") > 20).alias("truth"))
    return alerts.with_missing(recent, g, BY)


@query("alert_state_machine")
def _(spark, d):
    g = views.gauges(spark, d).select(F.concat_ws("/", *BY).alias("series"), (F.col("t") / NANO).cast("long").alias("t"), F.when(F.col("stale"), "unknown").otherwise("condition").alias("kind"), (F.col("value") > 12).alias("truth"), F.lit(0).cast("long").alias("cursor"))
    return alerts.run(g, alerts.Rule("demo", "high-value", hold_seconds=40))


@query("alert_retry_wait", "SELECT event_id, CAST(least(power(2, least(event_id % 12, 8)), 300) AS BIGINT) AS wait FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", alerts.retry_seconds(F.col("event_id") % 12).alias("wait"))


# Ingest and storage.
RETRY = f"WITH RECURSIVE {views.RETRIES_SQL}, "
DEDUPE_US = 4 * 86_400_000_000


@query("dedupe_6h", RETRY + f"""o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cursor) AS i FROM retries),
f AS (SELECT event_id, cursor, i, accepted AS anchor, cursor AS original FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.cursor, o.i, CASE WHEN f.anchor < o.accepted - {DEDUPE_US} THEN o.accepted ELSE f.anchor END, CASE WHEN f.anchor < o.accepted - {DEDUPE_US} THEN o.cursor ELSE f.original END FROM f JOIN o ON o.event_id = f.event_id AND o.i = f.i + 1)
SELECT event_id, cursor, original FROM f""")  # fmt: skip
def _(spark, d):
    # The table's ids come again days apart, so the window is four days here instead of six hours.
    return ingest.dedupe(views.retries(spark, d), DEDUPE_US).select("event_id", "cursor", "original")


@query("retention_filter", L + f"SELECT {SHOWN_SQL} FROM logs WHERE occurred_ns >= {T1 - 7 * logs.DAY_NS}")
def _(spark, d):
    return ingest.retained(views.logs(spark, d), T1, 7).select(*SHOWN)


@query("retention_ranges", L + f"SELECT min(cursor) AS first, max(cursor) AS last, count(*) AS n FROM (SELECT cursor, cursor - row_number() OVER (ORDER BY cursor) AS i FROM logs WHERE occurred_ns < {T1} AND service <> 'view') GROUP BY i")
def _(spark, d):
    _, ranges = store.expire(views.logs(spark, d).where("service <> 'view'"), T1)
    return ranges.select("first", "last", "n")


@query("govern_redact", "SELECT conv_id, turn, role, CASE WHEN octet_length(encode(text)) <= 64 THEN text ELSE left(text, list_max(list_filter(range(0, 65), lambda k: octet_length(encode(left(text, k))) <= 64))) END AS note, '[REDACTED]' AS prompt, '[REDACTED]' AS secret FROM conversations")
def _(spark, d):
    c = views.table(spark, d, "conversations")
    attrs = F.create_map(F.lit("gen_ai.system"), F.col("role"), F.lit("gen_ai.prompt"), F.col("text"), F.lit("Secret"), F.lit("x"), F.lit("note"), F.col("text"))
    out = c.select("conv_id", "turn", "role", ingest.govern(attrs, denied=["SECRET"], most=64).alias("a"))
    get = lambda k: F.try_element_at("a", F.lit(k))
    return out.select("conv_id", "turn", get("gen_ai.system").alias("role"), get("note").alias("note"), get("gen_ai.prompt").alias("prompt"), get("Secret").alias("secret"))


@query("quota_window", L + f"SELECT project, occurred_ns - occurred_ns % {logs.DAY_NS} AS window_start, count(*) AS items, count(*) > 330 AS over FROM logs GROUP BY ALL")
def _(spark, d):
    return ingest.over_quota(views.logs(spark, d), 330, 86_400)


@query("validation_split", L + "SELECT cursor, 'metric value is not finite' AS reason FROM logs WHERE cursor % 50 = 0 UNION ALL SELECT cursor, 'environment is blank' FROM logs WHERE cursor % 70 = 1")
def _(spark, d):
    some = views.logs(spark, d).withColumn("value", F.when(F.col("cursor") % 50 == 0, float("nan")).otherwise(F.col("value"))).withColumn("environment", F.when(F.col("cursor") % 70 == 1, " ").otherwise(F.col("environment")))
    return ingest.split_valid(some)[1].select("cursor", "reason")


@query("partial_success", L + """, r AS (SELECT service, cursor, 'payload is null' AS reason, row_number() OVER (PARTITION BY service ORDER BY cursor) AS k FROM logs WHERE cursor % 40 = 0)
SELECT service, count(*) AS rejected, string_agg(reason, '; ' ORDER BY k) FILTER (k <= 8) AS messages FROM r GROUP BY service""")  # fmt: skip
def _(spark, d):
    some = views.logs(spark, d).withColumn("payload", F.when(F.col("cursor") % 40 != 0, F.col("payload")))
    return ingest.batch_messages(ingest.split_valid(some)[1], "service")


@query("cursor_assignment", "SELECT l_orderkey AS a, l_linenumber AS b, 1000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS cursor FROM lineitem")
def _(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return ingest.with_cursors(views.table(spark, d, "lineitem").select(*order), 1000, order).select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("cursor").cast("long").alias("cursor"))


@query("stable_id", L + "SELECT cursor, sha256(project || chr(0) || service || chr(0) || trace_id) AS id FROM logs WHERE false OR true")
def _(spark, d):
    return views.logs(spark, d).select("cursor", ingest.stable_id(F.col("project"), F.col("service"), F.col("trace_id")).alias("id"))




@query("log_normalize", L + "SELECT cursor, CASE WHEN cursor % 3 = 0 THEN 'message ' || trace_id WHEN cursor % 3 = 1 THEN 'body ' || trace_id ELSE '{\"n\":' || trace_id || '}' END AS body FROM logs")
def _(spark, d):
    part = F.concat(F.lit('"'), F.when(F.col("cursor") % 3 == 0, "message").otherwise("body"), F.lit(" "), F.col("trace_id"), F.lit('"'))
    payload = (
        F.when(F.col("cursor") % 3 == 0, F.concat(F.lit('{"jsonPayload":{"message":'), part, F.lit(',"body":"other"}}')))
        .when(F.col("cursor") % 3 == 1, F.concat(F.lit('{"body":'), part, F.lit("}")))
        .otherwise(F.concat(F.lit('{"jsonPayload": {"n": '), F.col("trace_id"), F.lit("}}")))
    )
    return views.logs(spark, d).select("cursor", ingest.body_text(F.create_map().cast("map<string,string>"), payload).alias("body"))


@query("cold_hot_union", L + f"SELECT cursor, service, CASE WHEN cursor <= 400 THEN 'cold' ELSE 'hot' END AS part FROM logs")
def _(spark, d):
    e = views.logs(spark, d)
    cold, hot = e.where("cursor <= 500").withColumn("part", F.lit("cold")), e.where("cursor > 300").withColumn("part", F.lit("hot"))
    return store.cold_and_hot(cold, hot, 400).select("cursor", "service", "part")


@query("ordered_merge", L + "SELECT cursor, service FROM logs WHERE service IN ('click', 'view', 'error') ORDER BY cursor")
def _(spark, d):
    e = views.logs(spark, d).select("cursor", "service")
    return store.merge_ordered(*(e.where(F.col("service") == s) for s in ("click", "view", "error")))


_XOR = " || ".join(f"lpad(lower(to_hex(bit_xor(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)))), 8, '0')" for i in range(8))


@query("set_digest", L + f"SELECT service, {_XOR} AS digest, count(*) AS n FROM (SELECT service, sha256(event_id) AS h FROM logs) GROUP BY service")
def _(spark, d):
    return store.set_digest(views.logs(spark, d), F.col("event_id"), ["service"])


@query("shard_route", L + """, ep AS (SELECT 1 AS epoch, 0 AS a, 2000 AS b UNION ALL SELECT 2, 2000, 6000 UNION ALL SELECT 3, 6000, 999999999)
SELECT cursor, CAST(('0x' || substr(sha256(event_id), 1, 4)) AS INT) % 4096 AS bucket, epoch FROM logs JOIN ep ON cursor >= a AND cursor < b""")  # fmt: skip
def _(spark, d):
    epochs = spark.createDataFrame([(1, 0), (2, 2000), (3, 6000)], "epoch int, activation long")
    return store.route(views.logs(spark, d), epochs).select("cursor", store.shard(F.col("event_id")).alias("bucket"), "epoch")


@query("blob_refs", "SELECT page_id, 'sha256:' || sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE length(base64(encode(html))) >= 2000")
def _(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", F.translate(F.base64(F.col("html").cast("binary")), "\r\n", "").alias("payload"))
    refs, _ = ingest.blobs(pages, "payload", 2000)
    return refs.where("blob_ref IS NOT NULL").select("page_id", "blob_ref.hash", "blob_ref.size")


@query("blob_gc", "SELECT sha256(html) AS hash FROM pages GROUP BY 1 HAVING bool_and(page_id % 3 <> 0)")
def _(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    return store.unused(pages.select("hash").distinct(), pages.where("page_id % 3 = 0"))

