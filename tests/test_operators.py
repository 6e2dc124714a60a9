import random

import pytest
from pyspark.sql import functions as F

from heliograph.functions.values import NANO, divide, floor_to, max_value, min_value, plain_number
from heliograph.operators import alerts, control, errors, filters, ingest, metrics, store, traces
from heliograph.sources import lines, remote_write


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    inf, nan = float("inf"), float("nan")
    d = lambda a, b: one(spark, divide(F.lit(a), F.lit(b)))
    assert d(1.0, 4.0) == 0.25 and d(1.0, 0.0) == inf and d(-1.0, 0.0) == -inf and d(0.0, 0.0) != d(0.0, 0.0) and d(nan, 0.0) != d(nan, 0.0)
    text = lambda v: one(spark, plain_number(F.lit(v)))
    assert [text(v) for v in (9.0, 0.5, 1e21, nan, inf, -inf, -3.25)] == ["9", "0.5", "1000000000000000000000", "NaN", "+Inf", "-Inf", "-3.25"]
    df = spark.createDataFrame([(nan,), (2.0,), (5.0,)], "v double")
    assert df.agg(min_value(F.col("v")), max_value(F.col("v"))).first() == (2.0, 5.0)
    assert [one(spark, floor_to(F.lit(t).cast("long"), 60)) for t in (-1, 0, 59, 60)] == [-60, 0, 0, 60]


def plain_filter(tree, doc):
    """The language over plain dictionaries."""
    import re

    def find(name):
        if name in doc:
            return True, doc[name]
        first, _, rest = name.partition(".")
        if not rest or not isinstance(doc.get(first), dict):
            return False, None
        at = doc[first]
        if rest in at:
            return True, at[rest]
        for part in rest.split("."):
            if not isinstance(at, dict) or part not in at:
                return False, None
            at = at[part]
        return True, at

    op = tree["op"]
    if op == "and":
        return all(plain_filter(a, doc) for a in tree["args"])
    if op == "or":
        return any(plain_filter(a, doc) for a in tree["args"])
    if op == "not":
        return not plain_filter(tree["arg"], doc)
    there, value = find(tree["field"])
    same = lambda a, b: type(a) is type(b) and a == b
    text = value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else None
    if op == "eq":
        return there and same(value, tree["value"])
    if op == "in":
        return there and any(same(value, v) for v in tree["values"])
    if op == "exists":
        return there and value is not None
    if op == "text":
        return there and text is not None and tree["value"].lower() in text.lower()
    if op == "regex":
        return there and text is not None and re.search(tree["pattern"], text) is not None
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    for k, test in (("gt", float.__gt__), ("gte", float.__ge__), ("lt", float.__lt__), ("lte", float.__le__)):
        if tree.get(k) is not None:
            b = tree[k]
            if number(value) and number(b):
                if not test(float(value), float(b)):
                    return False
            elif isinstance(value, str) and isinstance(b, str):
                if not {"gt": value > b, "gte": value >= b, "lt": value < b, "lte": value <= b}[k]:
                    return False
            else:
                return False
    return there


def test_filters_on_random_trees(spark):
    import json

    rng = random.Random(6)
    values = [1, 2, "1", "a", "Ab c", True, False, None, 2.5, {"x": 1}, [1]]
    docs = [{k: rng.choice(values) for k in rng.sample(["a", "b", "b.c", "d"], rng.randint(0, 4))} | ({"n": {"m": rng.choice(values), "p.q": rng.choice(values)}} if rng.random() < 0.5 else {}) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, p string").cache()
    fields = ["p.a", "p.b", "p.b.c", "p.n.m", "p.n.p.q", "p.none", "other"]

    def tree(depth):
        op = rng.choice(["and", "or", "not", "eq", "in", "exists", "range", "text", "regex"] if depth else ["eq", "in", "exists", "range", "text", "regex"])
        if op in ("and", "or"):
            return {"op": op, "args": [tree(depth - 1) for _ in range(rng.randint(1, 3))]}
        if op == "not":
            return {"op": op, "arg": tree(depth - 1)}
        out = {"op": op, "field": rng.choice(fields)}
        scalar = [v for v in values if not isinstance(v, (dict, list))]
        more = {"eq": {"value": rng.choice(values)}, "in": {"values": rng.choices(scalar, k=2)}, "exists": {}, "range": {rng.choice(["gt", "gte"]): rng.choice([1, 1.5, "a"]), "lte": rng.choice([2, "b"])}, "text": {"value": rng.choice(["A", "1", "ru", ""])}, "regex": {"pattern": rng.choice(["^a", r"\d", "b", "e$"])}}
        return out | more[op]

    trees = [tree(2) for _ in range(60)]
    document = filters.Document({}, json={"p": F.col("p")})
    for begin in range(0, len(trees), 20):
        part = trees[begin : begin + 20]
        got = df.select("i", *(filters.compile_filter(t, document).alias(f"c{j}") for j, t in enumerate(part))).collect()
        for r in got:
            for j, t in enumerate(part):
                assert r[f"c{j}"] == plain_filter(t, {"p": docs[r.i]}), (t, docs[r.i])


@pytest.mark.parametrize("tree", [{}, {"op": "eq", "field": "a"}, {"op": "and", "args": []}, {"op": "range", "field": "a"}, {"op": "range", "field": "a", "gt": 1, "gte": 2}, {"op": "eq", "field": "", "value": 1}, {"op": "regex", "field": "a", "pattern": "("}, {"op": "regex", "field": "a", "pattern": "(?=x)"}, {"op": "regex", "field": "a", "pattern": "x" * 1025}, {"op": "in", "field": "a", "values": []}, {"op": "nope"}, {"op": "eq", "field": "a", "value": 1, "more": 2}])
def test_bad_filters(tree):
    with pytest.raises(filters.FilterError):
        filters.validate(tree)


def test_deep_filter():
    tree = {"op": "exists", "field": "a"}
    for _ in range(31):
        tree = {"op": "not", "arg": tree}
    filters.validate(tree)
    with pytest.raises(filters.FilterError):
        filters.validate({"op": "not", "arg": tree})


def points(spark, rows):
    return spark.createDataFrame([("s", t * NANO, c, float(v), s) for t, c, v, s in rows], "series string, t long, cursor long, value double, stale boolean")


def test_late_points_and_resets(spark):
    p = points(spark, [(0, 1, 10, False), (20, 2, 3, False), (10, 3, 15, False), (30, 4, 99, True)])
    assert metrics.totals(p, ["series"], "cumulative").first() == ("s", 8.0, 1)
    assert metrics.totals(p, ["series"], "gauge").first() == ("s", 3.0, 0) and metrics.totals(p, ["series"], "delta").first() == ("s", 28.0, 0)
    assert metrics.rollup(p, ["series"], 60).first()["point_count"] == 3 and metrics.rollup(p, ["series"], 60).first()["last"] == 3.0
    only = points(spark, [(0, 1, 0, True)])
    assert metrics.aggregate(only, ["series"], "gauge", "raw").first().value is None and metrics.aggregate(only, ["series"], "gauge", "sum").first().value is None
    assert metrics.aggregate(p, ["series"], "cumulative", "rate").first().value == 0.4


def test_overflow_takes_series_in_order_of_sight(spark):
    df = spark.createDataFrame([("p", r, i) for i, r in enumerate("abacdb")], "project string, route string, cursor long")
    got = {r.cursor: r.overflow for r in metrics.limit_cardinality(df, ["route"], ["project"], 2).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_histograms_with_other_bounds_are_an_error(spark):
    df = spark.createDataFrame([("a", [1.0], [1, 2], 3, 1.0, 0.0, 1.0), ("a", [2.0], [1, 2], 3, 1.0, 0.0, 1.0)], "g string, bounds array<double>, counts array<bigint>, count long, sum double, min double, max double")
    with pytest.raises(Exception, match="bounds differ"):
        metrics.merge_histograms(df, ["g"], 1).collect()


def spans(spark, rows):
    return spark.createDataFrame([("p", "t", s, q, a, b, "op", c) for c, (s, q, a, b) in enumerate(rows)], "project string, trace_id string, span_id string, parent_id string, start long, stop long, operation string, cursor long")


def assemble(spark, rows):
    s = traces.with_parents(traces.latest(traces.valid(spans(spark, rows))))
    return traces.summary(s).first(), traces.gaps(s).collect(), traces.cycles(s).collect(), traces.critical_path(s).first(), s


def test_trace_of_a_leaf_first(spark):
    summary, gaps, cycles, path, s = assemble(spark, [("leaf", "child", 200, 350), ("child", "root", 150, 400), ("root", None, 100, 500)])
    assert (summary.roots, summary.duration, summary.partial) == ("root", 400, False) and not gaps and not cycles
    assert path.path == ["root", "child", "leaf"] == traces.critical_path(s).first().path


def test_absent_parent_and_cycle(spark):
    summary, gaps, cycles, _, _ = assemble(spark, [("child", "absent", 0, 1)])
    assert summary.roots == "child" and summary.partial and [g.gap for g in gaps] == ["missing_parent:child:absent"]
    summary, gaps, cycles, path, _ = assemble(spark, [("a", "b", 0, 5), ("b", "a", 0, 1)])
    assert summary.partial and summary.roots == "" and [c.cycle for c in cycles] == [["a", "b"]] and path.path == ["a", "b"]
    summary, gaps, cycles, _, _ = assemble(spark, [("r", None, 0, 9), ("z", "z", 0, 5), ("c", "r", 0, 1), ("c", "r", 0, 2)])
    assert [c.cycle for c in cycles] == [["z"]] and summary.conflicts == 1 and [g.gap for g in gaps] == ["conflicting_span:c"]


def test_deep_chains_and_cycles_with_tails(spark):
    deep = [(f"d{i:03}", f"d{i - 1:03}" if i else None, 0, i + 1) for i in range(200)]
    _, _, cycles, path, s = assemble(spark, deep)
    assert not cycles and len(path.path) == 200 and path.length == sum(range(1, 201)) and traces._unreached(s).isEmpty()
    ring = [(f"r{i}", f"r{(i + 1) % 5}", 0, 1) for i in range(5)] + [("t0", "r0", 0, 9), ("t1", "t0", 0, 9), ("x", "y", 0, 1), ("y", "x", 0, 1)]
    _, _, cycles, path, s = assemble(spark, ring)
    assert sorted(c.cycle for c in cycles) == [["r0", "r1", "r2", "r3", "r4"], ["x", "y"]] and traces._unreached(s).count() == 9
    assert path.length == 23 and path.path[-2:] == ["t0", "t1"]


def test_fingerprints_equal_a_plain_form(spark):
    import re

    form = re.compile(r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b0x[0-9a-f]+\b|\b\d+(?:\.\d+)?\b")
    plain = lambda t: re.sub(r"\s+", " ", form.sub("?", t)).strip(" ")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").select("text")
    more = spark.createDataFrame([("x" * 900 + " é12 12é 3.5 0xFF — ١٢ 12_3 1.2.3",), ("",), ("  9  ",), ("user 123e4567-e89b-12d3-a456-426614174000 gone",)], "text string")
    from heliograph.operators import errors

    for r in docs.union(more).select("text", errors.fingerprint(F.col("text")).alias("p")).collect():
        assert r.p == plain(r.text)


def test_scrape_checks(spark):
    text = ["# TYPE a counter", "# TYPE a gauge", "a 1", "# TYPE h histogram", 'h_bucket{le="+Inf"} 2', "# TYPE z wrong", "z 1", "b 2", "b 2", 'b{x="1"} 2', "c 3 1000", "c 3 2000"]
    df = spark.createDataFrame([(1, line) for line in text] + [(2, "a 1")], "scrape int, line string")
    got = sorted((r.scrape, r.name, r.counter, r.error) for r in lines.scraped(df).select("scrape", "name", "counter", F.coalesce("error", F.lit("")).alias("error")).collect())
    assert got == sorted([(1, "a", True, "repeated TYPE"), (1, "h_bucket", True, ""), (1, "z", False, "invalid TYPE"), (1, "b", False, "duplicate sample"), (1, "b", False, "duplicate sample"), (1, "b", False, ""), (1, "c", False, ""), (1, "c", False, ""), (2, "a", False, "")])


def test_scraped_series_that_go_on(spark, tmp_path):
    """Samples of one series without a time, and repeated events, are samples of scrapes that follow each other."""
    from heliograph.plans import queries, source_queries  # noqa: F401

    events = [(i, 7, "click", 0.25 * i) for i in (1, 3, 5, 5, 13, 26)] + [(2, 7, "view", 1.0), (2, 7, "view", 2.0)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = queries.QUERIES["prom_text_parse"](spark, str(tmp_path)).collect()
    got = sorted((r.event_id, r.name or "", r.value or 0.0, r.timestamp or "", r.counter, r.error or "") for r in out)
    bad = [(i, "", 0.0, "", False, "invalid sample") for i in (13, 26)]
    assert got == sorted([(i, "reqs_click", 0.25 * i, "", True, "") for i in (1, 3, 5, 5)] + [(2, "reqs_view", v, "2", False, "") for v in (1.0, 2.0)] + bad)


def test_broken_envelopes_are_error_rows(spark):
    from heliograph.sources import otlp

    good = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"5","body":{"stringValue":"x"}}]}]}]}'
    df = spark.createDataFrame([(1, "not json"), (2, "{}"), (3, good), (4, '{"resourceLogs":[{"resource":{}}]}'), (5, None)], "i int, envelope string")
    got = {r.i: (r.body, r.error) for r in otlp.logs(df, project="p", keep=("i",)).collect()}
    assert got == {3: ("x", None)} | {i: (None, otlp.EMPTY) for i in (1, 2, 4, 5)}
    for f in (otlp.spans, otlp.metrics):
        assert {r.error for r in f(df, project="p", keep=("i",)).collect()} == {otlp.EMPTY}


def test_log_selection_by_ids_and_attributes(spark):
    from heliograph.operators import logs

    rows = [(1, "p", "s1", {"request.id": "r", "k": "v"}), (2, "p", "s2", {"request.id": "q", "session.id": "z"}), (3, "p", "s1", {"resource.type": "host"}), (4, "p", None, None)]
    df = spark.createDataFrame(rows, "cursor long, project string, span_id string, attributes map<string,string>")
    ids = lambda **by: sorted(r.cursor for r in logs.select(df, "p", **by).collect())
    assert ids(span_id="s1") == [1, 3] and ids(request_id="r", attributes={"k": "v"}) == [1] and ids(session_id="z") == [2] and ids(resource_type="host") == [3] and ids(attributes={"k": "w"}) == []


def test_label_patterns_match_whole_values(spark):
    p = spark.createDataFrame([("up", {"a": v}, 0, 0, 1.0, False) for v in ("x", "x\n", "x\ny")], "name string, labels map<string,string>, t long, cursor long, value double, stale boolean")
    from heliograph.plans import promql

    tree = promql.parse('up{a=~"x"}'), promql.parse('up{a=~"x.*"}')
    test = lambda t: {r.a for r in p.select(F.col("labels")["a"].alias("a")).where(F.col("a").rlike(rf"(?s)^(?:{t.matchers[0].value})\z")).collect()}
    assert test(tree[0]) == {"x"} and test(tree[1]) == {"x", "x\n", "x\ny"}


def test_shard_map_epochs(spark):
    from heliograph.operators import store

    epochs = spark.createDataFrame([(10 * k, k) for k in range(1, 38)], "activation long, epoch int")
    got = {r.cursor: r.epoch for r in store.route(spark.range(400).withColumnRenamed("id", "cursor"), epochs).collect()}
    assert got == {c: min(c // 10, 37) if c >= 10 else None for c in range(400)}
    assert store.route(spark.range(3).withColumnRenamed("id", "cursor"), epochs.limit(0)).first().epoch is None


def test_path_ties_and_depth():
    assert traces.best_path([("r", None, 1), ("b", "r", 5), ("a", "r", 5)]) == (6, ["r", "a"])
    deep = [("s0", None, 1)] + [(f"s{i}", f"s{i - 1}", 1) for i in range(1, 5000)]
    assert traces.best_path(deep)[0] == 5000
    assert traces.best_path([]) == (0, [])


def test_dedupe_window_is_inclusive_and_greedy(spark):
    acks = [0, 21600, 21601, 40000, 43202, 43203]
    df = spark.createDataFrame([("p", "e", i, a) for i, a in enumerate(acks)], "project string, event_id string, cursor long, accepted long")
    got = ingest.dedupe(df, ingest.DEDUPE_SECONDS).orderBy("cursor").collect()
    assert [acks[r.cursor] for r in got if r.cursor == r.original] == [0, 21601, 43202]


def test_governance(spark):
    attrs = F.create_map(*(F.lit(x) for x in ("gen_ai.prompt", "p", "LLM.input_messages_bytes", "q", "note.response", "r", "user", "é" * 10, "Token", "t")))
    got = one(spark, ingest.govern(attrs, denied=["token"], most=5))
    assert got == {"gen_ai.prompt": "[REDACTED]", "LLM.input_messages_bytes": "[REDACTED]", "note.response": "[REDACTED]", "user": "éé", "Token": "[REDACTED]"}
    assert one(spark, ingest.govern(F.create_map(F.lit("prompt"), F.lit("kept")), most=50)) == {"prompt": "kept"}
    assert one(spark, ingest.govern(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), allowed=["A"])) == {"a": "1", "b": "[REDACTED]"}


def test_truncation_ends_between_characters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé日😀") for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (1, 4, 7, 11):
        for r in df.select("t", ingest.truncated(F.col("t"), most).alias("x")).collect():
            assert r.x == r.t.encode()[:most].decode(errors="ignore")


def test_cursors_are_contiguous(spark):
    df = spark.createDataFrame([(f"{i:04}",) for i in range(500)], "k string").repartition(7)
    assert [r.cursor for r in ingest.with_cursors(df, 10, ["k"]).orderBy("k").collect()] == list(range(11, 511))


def test_set_digest_is_the_xor_of_hashes(spark):
    import hashlib

    want = 0
    for i in range(50):
        want ^= int(hashlib.sha256(str(i).encode()).hexdigest(), 16)
    got = store.set_digest(spark.range(50).repartition(5), F.col("id").cast("string"), []).first()
    assert got.digest == f"{want:064x}" and got.n == 50


def test_events_table_prunes(spark, tmp_path):
    day = 86_400 * NANO
    df = spark.createDataFrame([("log", f"e{i}", i, i * day // 4) for i in range(1, 40)], "signal string, event_id string, cursor long, occurred_ns long")
    store.write_events(df, str(tmp_path / "events"))
    table = spark.read.parquet(str(tmp_path / "events"))
    part = store.scan(table, start=2 * day, stop=4 * day, after=9)
    assert sorted(r.cursor for r in part.collect()) == list(range(10, 16))
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().toString()


def test_fingerprints(spark):
    texts = {"Failed 12 times at 0xFF in 3.5s": "Failed ? times at ? in ?s", "id 123e4567-E89b-12d3-a456-426614174000  gone\n now": "id ? gone now", "x12 y": "x12 y", " 7 ": "?"}
    texts["Failed 12 times at 0xFF in 3.5s"] = "Failed ? times at ? in ?.5s"
    for text, want in texts.items():
        assert one(spark, errors.fingerprint(F.lit(text))) == want
    payload = F.lit('{"exception":{"type":"Boom"},"json":{"version":"2"}}')
    none = F.create_map().cast("map<string,string>")
    assert one(spark, errors.text_field(none, payload, "exception.type")) == "Boom" and one(spark, errors.text_field(none, payload, "version")) == "2" and one(spark, errors.text_field(none, payload, "absent")) is None


def test_alert_machine():
    rule = alerts.Rule("p", "r", hold_seconds=30)
    truth = lambda x: alerts.Seen("condition", x)
    got = alerts.fold(rule, "a", [(0, truth(True)), (29, truth(True)), (30, truth(True)), (40, truth(True)), (50, alerts.Seen("unknown")), (60, truth(True)), (70, truth(False)), (80, truth(False))])
    assert [(p, n) for _, p, _, n in got] == [("pending", None), ("pending", None), ("firing", "firing"), ("firing", None), ("unknown", None), ("firing", None), ("inactive", "resolved"), ("inactive", None)]
    assert [n for *_, n in alerts.fold(alerts.Rule("p", "r", mute_until=15), "a", [(0, truth(True)), (10, truth(True)), (20, truth(True)), (30, truth(False))])] == [None, None, "firing", "resolved"]
    assert [n for *_, n in alerts.fold(alerts.Rule("p", "r", mute_until=99), "a", [(0, truth(True)), (10, truth(False))])] == [None, None]
    event = lambda c: alerts.Seen("event", cursor=c)
    assert [(e, n) for _, _, e, n in alerts.fold(alerts.Rule("p", "r"), "a", [(0, event(5)), (1, event(5)), (2, event(6))])] == [(1, "firing"), (1, None), (2, "firing")]
    assert alerts.fold(alerts.Rule("p", "r", no_data="firing"), "a", [(0, alerts.Seen("no_data"))])[0][3] == "firing"
    with pytest.raises(ValueError):
        alerts.fold(rule, "a", [(5, truth(True)), (4, truth(True))])


def test_alert_runs_equal_the_fold(spark):
    rng = random.Random(3)
    rows = [(s, t, rng.choice(["condition"] * 5 + ["unknown", "no_data"]), rng.random() < 0.6, 0) for s in "ab" for t in range(0, 300, 10)]
    rule = alerts.Rule("p", "r", hold_seconds=15)
    got = sorted((r.series, r.t, r.phase, r.episode, r.transition or "") for r in alerts.run(spark.createDataFrame(rows, "series string, t long, kind string, truth boolean, cursor long"), rule).collect())
    want = sorted((s, t, p, e, n or "") for s in "ab" for t, p, e, n in alerts.fold(rule, "x", [(r[1], alerts.Seen(r[2], r[3])) for r in rows if r[0] == s]))
    assert got == want


def test_control_commands():
    change = lambda i, rev, v=1: control.Change("p", "rule", i, rev, v)
    s = control.Store().apply("1", [change("a", 0), change("b", 0)])
    assert s.receipts["1"].applied and s.records[("p", "rule", "a")] == (1, 1)
    bad = s.apply("2", [change("a", 1, 2), change("b", 5)])
    assert not bad.receipts["2"].applied and bad.records == s.records
    assert bad.apply("1", [change("c", 0)]).records == s.records and not s.apply("3", [change("c", 0), change("c", 0)]).receipts["3"].applied
    for i in range(4200):
        s = s.apply(f"r{i}", [])
    assert len(s.receipts) == control.MAX_RECEIPTS and "1" not in s.receipts


def test_remote_write_bytes(spark):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda n, raw: varint(n << 3 | 2) + varint(len(raw)) + raw
    import struct

    sample = lambda v, t: field(2, b"\x09" + v + b"\x10" + varint(t))
    label = lambda k, v: field(1, field(1, k) + field(2, v))
    body = field(1, label(b"__name__", b"up_total") + label(b"service.name", b"api") + sample(struct.pack("<d", 2.5), 1000) + sample(remote_write.STALE_BITS.to_bytes(8, "little"), 2000))
    df = spark.createDataFrame([(body,), (body[:-3],), (None,)], "body binary")
    import pyarrow as pa

    packed = spark.createDataFrame([(bytearray(pa.compress(body, codec="snappy", asbytes=True)),), (bytearray(b"\xff\xff\xff"),)], "body binary")
    shown = lambda d: sorted((r.timestamp, r.value) for r in d.where("error IS NULL").collect())
    assert shown(remote_write.decode(packed, snappy=True)) == [(1000, 2.5), (2000, 0.0)] and remote_write.decode(packed, snappy=True).where("error IS NOT NULL").count() == 1
    rows = remote_write.decode(df)
    got = sorted(((r.name, r.t, r.value, r.stale, r.temporality, r.resource["service.name"]) for r in remote_write.points(rows.where("error IS NULL"), "p").collect()), key=str)
    assert got == [("up_total", 1_000_000_000, 2.5, False, "cumulative", "api"), ("up_total", 2_000_000_000, 0.0, True, "cumulative", "api")]
    assert rows.where("error IS NOT NULL").count() == 1


def test_scraped_histograms(spark):
    text = ["# TYPE h histogram", 'h_bucket{le="1"} 2', 'h_bucket{le="+Inf"} 3', "h_count 3", "h_sum 4", "# TYPE g histogram", 'g_bucket{le="1"} 5', 'g_bucket{le="+Inf"} 4', "g_count 4", "bad{ 1", "n NaN", "ok 1e3 -5"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "scrape int, i int, line string")
    out = lines.scraped(df).cache()
    assert {r.name: r.counter for r in out.where("error IS NULL").collect()} == {"h_bucket": True, "h_count": True, "h_sum": True, "g_bucket": True, "g_count": True, "ok": False}
    assert out.where("error IS NOT NULL").count() == 2 and out.where("name = 'ok'").first()["timestamp"] == -5
    assert [(r.family, r.problem) for r in lines.scraped_histogram_problem(out.where("error IS NULL"), ["scrape"]).collect()] == [("g", "buckets fall")]


def test_source_budget(spark):
    rows = spark.range(100)
    assert store.within_budget(rows, 100).count() == 100
    assert store.within_budget(rows.limit(0), 1).count() == 0
    for limits in ({"most": 99}, {"size": 10}):
        with pytest.raises(ValueError, match="narrow it"):
            store.within_budget(rows, **limits)


def test_error_feed_takes_each_record_once(spark):
    rows = [(c, "p", "e", "s", "ERROR" if c % 3 else "INFO", f"failed {c}") for c in range(1, 24)]
    logs = spark.createDataFrame(rows, "cursor long, project string, environment string, service string, severity string, body string")
    seen, at = [], 0
    while True:
        page, end = errors.feed(logs, at, 5)
        if end == at:
            assert page.isEmpty()
            break
        seen += [r["cursor"] for r in page.collect()]
        at = end
    assert (sorted(seen), at) == ([c for c in range(1, 24) if c % 3], 23)
    with pytest.raises(ValueError):
        errors.feed(logs, 0, 501)


def test_first_versions_stay(spark):
    rows = [("g", c, v) for c, v in enumerate(["b", "a", None, "b", "c", "d"])] + [("h", 9, None)]
    found = errors.versions(spark.createDataFrame(rows, "group_id string, cursor long, v string"), F.col("v"), 3).collect()
    assert [(r["group_id"], r["versions"]) for r in found] == [("g", ["a", "b", "c"])]


def test_newest_spans_and_overflow_fold(spark):
    spans = spark.createDataFrame([(1,), (5,), (3,), (3,)], "cursor long")
    assert sorted(r[0] for r in traces.newest(spans, 2).collect()) == [3, 3, 5]
    assert traces.newest(spans.limit(0), 2).count() == 0
    points = spark.createDataFrame([("p", s, c) for c, s in enumerate("abcacd")], "project string, series string, cursor long")
    got = metrics.fold_overflow(points, ["series"], ["project"], 2).groupBy("series", "overflow").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {("a", False, 2), ("b", False, 1), (None, True, 3)}
