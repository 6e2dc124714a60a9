import time

import pytest
from pyspark.sql import functions as F

from heliograph.functions.values import NANO
from heliograph.operators import alerts
from heliograph.plans import requests
from heliograph.sources import views
from heliograph.streaming import jobs

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    gauges = views.gauges(spark, WHERE).withColumn("environment", F.lit("prod")).withColumn("labels", F.create_map(F.lit("service"), F.col("service"), F.lit("bucket"), F.col("bucket")))
    return requests.Store(views.logs(spark, WHERE), gauges, views.spans(spark, WHERE).withColumn("environment", F.lit("prod")).withColumn("attributes", F.create_map(F.lit("k"), F.col("status"))), "gauge")


def base(signal, **more):
    return {"version": 1, "project": "demo", "signal": signal} | more


def pages(store, request):
    out, cursor, n = [], None, 0
    while True:
        got = requests.run(store, request | ({"cursor": cursor} if cursor else {}))
        out, cursor, n = out + got.data, got.next_cursor, n + 1
        if cursor is None:
            return out, n


def test_log_pages_hold_each_row_once(store):
    rows, n = pages(store, base({"kind": "logs", "filter": {"op": "eq", "field": "service", "value": "error"}}, limit=300, environment="prod"))
    want = store.logs.where("service = 'error' AND environment = 'prod'").orderBy("cursor").collect()
    assert [r["cursor"] for r in rows] == [r.cursor for r in want] and n > 1


def test_a_page_may_be_empty_and_lead_on(store):
    got = requests.run(store, base({"kind": "logs", "filter": {"op": "eq", "field": "service", "value": "none"}}, limit=5))
    assert got.data == [] and got.next_cursor and got.watermark == 1000


def test_metric_and_trace_requests(store):
    rows, n = pages(store, base({"kind": "metrics", "name": "value", "function": "count"}, limit=7))
    assert len(rows) == 20 and n == 3 and sum(r["value"] for r in rows) == store.points.where("NOT stale").count()
    some, _ = pages(store, base({"kind": "metrics", "filter": {"op": "eq", "field": "labels.service", "value": "view"}}, limit=7))
    assert len(some) == 4 and {r["labels"]["service"] for r in some} == {"view"}
    rows, _ = pages(store, base({"kind": "traces", "attributes": {"k": "O"}, "filter": {"op": "range", "field": "n_spans", "gte": 3}}, limit=500))
    assert rows and all(r["n_spans"] >= 3 for r in rows)
    trace = requests.get_trace(store, "demo", rows[0]["trace_id"])
    assert trace["duration"] == rows[0]["duration"] and trace["critical_path"][0] in trace["roots"] and requests.get_trace(store, "demo", "none") is None


@pytest.mark.parametrize("change", [{"version": 3}, {"project": " "}, {"limit": 0}, {"limit": 1001}, {"extra": 1}, {"signal": {"kind": "x"}}, {"signal": {"kind": "logs", "y": 1}}, {"signal": {"kind": "logs", "filter": {"op": "z"}}}, {"time_range": {"start": "yesterday"}}, {"time_range": {"start": "2024-01-02T00:00:00Z", "end": "2024-01-01T00:00:00Z"}}, {"cursor": "metrics:MQ"}, {"cursor": "logs"}, {"signal": {"kind": "traces", "min_duration_ms": 2, "max_duration_ms": 1}}])
def test_refused(store, change):
    with pytest.raises(requests.RequestError):
        requests.run(store, base({"kind": "logs"}) | change)


def test_version_two(store):
    span = {"start": "1970-01-01T00:10:00Z", "end": "1970-01-01T00:12:00Z"}
    v2 = lambda signal, **m: requests.run_v2(store, {"version": 2, "project": "demo", "signal": signal} | m)
    got = v2({"kind": "metrics", "expression": "sum by (service) (value)"}, time_range=span).data
    assert len(got) == 5 and got[0]["type"] == "matrix" and len(got[0]["values"]) == 5
    assert v2({"kind": "metrics", "expression": "1 + 2"}, time_range={"end": span["end"]}).data == [{"type": "scalar", "value": 3.0}]
    assert v2({"kind": "metrics", "expression": "value"}, time_range={"end": span["end"]}).data[0]["type"] == "vector"
    day = {"start": "2024-01-05T00:00:00Z", "end": "2024-01-06T00:00:00Z"}
    start = 1_704_412_800 * NANO
    assert v2({"kind": "logs_count"}, time_range=day).data == [{"n": store.logs.where((F.col("occurred_ns") >= start) & (F.col("occurred_ns") < start + 86_400 * NANO)).count()}]
    for bad in ({"kind": "metrics", "expression": "rate("}, {"kind": "metrics", "expression": "1"}):
        with pytest.raises(requests.RequestError):
            v2(bad, time_range=span)


def test_small_dialect(store):
    assert requests.parse_mini('rate(value{service="view", bucket="1"})') == ("rate", "value", {"service": "view", "bucket": "1"})
    for bad in ("value[5m]", "topk(value)", 'value{a=~"b"}', "sum(value", 'value{a="b",a="c"}', "1"):
        with pytest.raises(requests.RequestError):
            requests.parse_mini(bad)
    rows = requests.prom_range(store, "demo", 'sum(value{service="view"})', 600 * NANO, 700 * NANO, 20 * NANO).collect()
    assert len(rows) == 6 and rows[0].labels == {}
    assert requests.prom_range(store, "demo", "value", 600 * NANO, 600 * NANO, NANO).first().labels["__name__"] == "value"


def test_times():
    assert requests.seconds_nanos("1.5") == 1_500_000_000 and requests.seconds_nanos("0.0000000005") == 1 and requests.seconds_nanos("-1e-9") == -1
    assert requests.rfc3339_nanos("1970-01-01T01:00:00.000000001+01:00") == 1 and requests.seconds_nanos("1970-01-01T00:00:01Z") == NANO
    for bad in ("1e30", "x", "1970-13-01T00:00:00Z"):
        with pytest.raises(requests.RequestError):
            requests.seconds_nanos(bad)


def test_jobs(store, tmp_path):
    own = requests.Jobs(str(tmp_path))
    job = requests.answer(store, base({"kind": "logs"}, limit=600), own)
    for _ in range(300):
        now = own.get(job["id"])
        if now["state"] in ("done", "failed"):
            break
        time.sleep(0.1)
    assert now["state"] == "done" and len(now["response"]["data"]) == 600
    (tmp_path / f"{'0' * 32}.json").write_text('{"id": "%s", "state": "running"}' % ("0" * 32))
    assert requests.Jobs(str(tmp_path)).get("0" * 32)["state"] == "failed" and own.get("../x") is None
    assert isinstance(requests.answer(store, base({"kind": "logs"}, limit=1), own), requests.Response)


def finished(df, name, mode="append"):
    # Timers would keep processAllAvailable() waiting; this trigger ends by itself.
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return df.sparkSession.table(name)


def test_stream_dedupe(spark, tmp_path):
    acks = [0, 21600, 21601, 40000, 43202, 43203]
    df = spark.createDataFrame([("p", k, i, a) for k in "xy" for i, a in enumerate(acks)], "project string, event_id string, cursor long, a long").withColumn("accepted", F.timestamp_seconds(F.col("a") + 1_700_000_000)).drop("a")
    df.where("cursor < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "project string, event_id string, cursor long, accepted timestamp"
    df.where("cursor >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = finished(jobs.dedupe(jobs.read_events(spark, str(tmp_path / "in"), schema)), "deduped")
    assert sorted((r.event_id, r.cursor) for r in got.collect()) == [(k, c) for k in "xy" for c in (0, 2, 4)]


def test_stream_rollups_and_views(spark, tmp_path):
    g = views.gauges(spark, WHERE)
    g.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_events(spark, str(tmp_path / "in"), g._jdf.schema().toDDL(), files=1)
    got = finished(jobs.rollups(stream().withColumn("at", F.timestamp_seconds(F.expr("t div 1000000000"))), ["service"], 60), "rolled", "complete")
    from heliograph.operators import metrics

    want = {(r.service, r.window_start // NANO): (r.point_count, round(r.sum, 6)) for r in metrics.rollup(g, ["service"], 60).collect()}
    assert {(r.service, int(r.window_start.timestamp())): (r.point_count, round(r.sum, 6)) for r in got.collect()} == want
    q = jobs.maintain_rollups(stream(), str(tmp_path / "view"), str(tmp_path / "check"), ["service"], 60)
    q.awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "view"))
    merged = {(r.service, r.window_start // NANO): (r.point_count, round(r.sum, 6), r.last) for r in jobs.merged_rollups(parts, ["service"]).collect()}
    assert {k: v[:2] for k, v in merged.items()} == want
    assert {k: v[2] for k, v in merged.items()} == {(r.service, r.window_start // NANO): r.last for r in metrics.rollup(g, ["service"], 60).collect()}
    assert jobs.wait_for(parts, 900) >= 900
    with pytest.raises(jobs.LagError):
        jobs.wait_for(parts, 10**9)


def test_stream_alerts_equal_the_fold(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(s, t, "condition", rng.random() < 0.6, 0) for t in range(0, 200, 10) for s in "ab"]
    schema = "series string, t long, kind string, truth boolean, cursor long"
    for i in range(2):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    rule = alerts.Rule("p", "r", hold_seconds=15)
    got = finished(jobs.alert_states(jobs.read_events(spark, str(tmp_path / "in"), schema, files=1), rule), "alerted")
    want = {(s, t, n, e) for s in "ab" for t, _, e, n in alerts.fold(rule, "x", [(r[1], alerts.Seen(r[2], r[3])) for r in rows if r[0] == s]) if n}
    assert {(r.series, r.t, r.transition, r.episode) for r in got.collect()} == want and want
