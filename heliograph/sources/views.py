"""Logs, points, histograms and spans over the driver's tables, as the engine's own row types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions.values import NANO

PROJECT = "demo"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("cursor"),
        F.col("event_id").cast("string").alias("event_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("occurred_ns"),
        F.lit(PROJECT).alias("project"),
        F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev").alias("environment"),
        F.col("event_type").alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"),
        F.concat_ws(" ", F.initcap("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("request"), F.col("event_id").cast("string")).alias("body"),
        F.col("props").alias("payload"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("value").alias("value"),
    )


LOGS_SQL = """logs AS (SELECT event_id + 1 AS cursor, CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) * 1000 AS occurred_ns, 'demo' AS project,
CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END AS environment, event_type AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
upper(event_type[1]) || event_type[2:] || ' user ' || user_id || ' request ' || event_id AS body, props AS payload, CAST(user_id AS VARCHAR) AS trace_id, value FROM events)"""


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on compressed time: one series a (service, bucket), about 20 s apart."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit(PROJECT).alias("project"),
        F.lit("value").alias("name"),
        F.col("event_type").alias("service"),
        (F.col("user_id") % 4).cast("string").alias("bucket"),
        (F.col("event_id") + 1).alias("cursor"),
        ((F.col("event_id") + 1) * NANO).alias("t"),
        F.col("value").alias("value"),
        (F.col("event_id") % 97 == 0).alias("stale"),
        F.col("user_id").cast("string").alias("trace_id"),
    )


GAUGES_SQL = """gauges AS (SELECT 'demo' AS project, 'value' AS name, event_type AS service, CAST(user_id % 4 AS VARCHAR) AS bucket, event_id + 1 AS cursor,
(event_id + 1) * 1000000000 AS t, value, event_id % 97 = 0 AS stale, CAST(user_id AS VARCHAR) AS trace_id FROM events)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums that start again every 25 points: resets."""
    by = ["service", "bucket"]
    g = gauges(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("t")) - 1)
    run = Window.partitionBy(*by, F.floor(F.col("n") / 25)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("value", F.sum(F.round(F.abs("value") * 16)).over(run) / 16).withColumn("name", F.lit("value_total")).drop("n")


COUNTERS_SQL = GAUGES_SQL + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY service, bucket ORDER BY t) - 1 AS n FROM gauges),
counters AS (SELECT project, 'value_total' AS name, service, bucket, cursor, t, sum(round(abs(value) * 16)) OVER (PARTITION BY service, bucket, n // 25 ORDER BY t ROWS UNBOUNDED PRECEDING) / 16 AS value, stale, trace_id FROM numbered)"""

BOUNDS = (10.0, 20.0, 30.0, 40.0)


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of quantities a return flag and day: bucket counts, count, sum, min, max."""
    li = table(spark, sf_dir, "lineitem")
    day = (F.unix_micros(F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))) * 1000).alias("t")
    place = F.lit(0)
    for b in BOUNDS:
        place = place + (F.col("l_quantity") > b).cast("int")
    per = li.select(F.col("l_returnflag").alias("series"), day, place.alias("b"), F.col("l_quantity").alias("q"))
    counts = [F.sum((F.col("b") == i).cast("long")).alias(f"c{i}") for i in range(len(BOUNDS) + 1)]
    out = per.groupBy("series", "t").agg(*counts, F.count("*").alias("count"), F.sum("q").alias("sum"), F.min("q").alias("min"), F.max("q").alias("max"))
    return out.select("series", "t", F.array(*map(F.lit, BOUNDS)).alias("bounds"), F.array(*(f"c{i}" for i in range(len(BOUNDS) + 1))).alias("counts"), "count", "sum", "min", "max")


HISTOGRAMS_SQL = """q AS (SELECT l_returnflag AS series, epoch_us(date_trunc('day', l_shipdate)) * 1000 AS t, l_quantity AS q,
(l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS b FROM lineitem),
histograms AS (SELECT series, t, count(*) FILTER (b = 0) AS c0, count(*) FILTER (b = 1) AS c1, count(*) FILTER (b = 2) AS c2, count(*) FILTER (b = 3) AS c3, count(*) FILTER (b = 4) AS c4,
count(*) AS count, sum(q) AS sum, min(q) AS min, max(q) AS max FROM q GROUP BY ALL)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of spans: a line of an order, its parent the line of half its number; some are delivered again."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    cursor = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) + F.col("l_orderkey") * 1000
    half = F.expr("l_linenumber div 2")
    return li.select(
        F.lit(PROJECT).alias("project"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.col("l_linenumber").cast("string").alias("span_id"),
        F.when(half > 0, half.cast("string")).alias("parent_id"),
        F.col("l_linenumber").cast("long").alias("start"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("stop"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("service"),
        F.concat(F.lit("part-"), (F.col("l_partkey") % 7).cast("string")).alias("operation"),
        cursor.cast("long").alias("cursor"),
    )


SPANS_SQL = """spans AS (SELECT 'demo' AS project, CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id,
CASE WHEN l_linenumber // 2 > 0 THEN CAST(l_linenumber // 2 AS VARCHAR) END AS parent_id, CAST(l_linenumber AS BIGINT) AS start, l_linenumber + CAST(l_quantity AS BIGINT) AS stop,
l_linestatus AS status, l_returnflag AS service, 'part-' || (l_partkey % 7) AS operation,
l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS cursor FROM lineitem)"""


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cursor"), F.col("source").alias("service"), F.col("text").alias("body"))


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose ids come again, with their accept time."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("cursor"), (F.col("event_id") % 1000).cast("string").alias("event_id"), F.lit(PROJECT).alias("project"), F.unix_micros(F.col("ts").cast("timestamp")).alias("accepted"))


RETRIES_SQL = "retries AS (SELECT event_id + 1 AS cursor, CAST(event_id % 1000 AS VARCHAR) AS event_id, 'demo' AS project, epoch_us(ts) AS accepted FROM events)"
