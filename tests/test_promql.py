"""Expressions against a plain evaluator that walks the points of each series at each step."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heliograph.functions.values import NANO
from heliograph.plans import promql


def made_points(seed):
    """Random counters with resets, gauges with gaps and stale marks, and buckets, at uneven times."""
    rng, out = random.Random(seed), []
    for zone in ("north", "south"):
        for node in ("n1", "n2", "n3"):
            for name in ("served", "dropped", "load"):
                value, at = 0.0, rng.randrange(40)
                for _ in range(45):
                    value = (rng.choice([0.0, 3.0]) if rng.random() < 0.1 else value + rng.randrange(9)) if name != "load" else rng.uniform(-5, 5)
                    out.append((name, {"zone": zone, "node": node}, at * NANO, value, name == "load" and rng.random() < 0.08))
                    at += rng.choice([7, 15, 15, 31]) + (400 if rng.random() < 0.02 else 0)
        counts = {"0.25": 0, "1": 0, "4": 0, "+Inf": 0}
        for i in range(40):
            for bound in counts:
                if rng.random() < 0.8:
                    counts = {b: c + (float(b.replace("+Inf", "inf")) >= float(bound.replace("+Inf", "inf"))) * rng.randrange(4) for b, c in counts.items()}
            top = 0
            for bound in counts:
                top = counts[bound] = max(top, counts[bound])
                out.append(("wait_bucket", {"zone": zone, "le": bound}, i * 20 * NANO, float(top), False))
    return out


def plain(tree, series, at):
    """{labels as sorted items: value} of a vector at one time, or a float."""
    bare = lambda labels, *names: tuple(x for x in labels if x[0] not in ("__name__", *names))
    picked = lambda labels, names: tuple(x for x in labels if x[0] in names)
    if isinstance(tree, promql.Number):
        return tree.value
    if isinstance(tree, (promql.Selector, promql.Change)):
        selector, out = getattr(tree, "selector", tree), {}
        for (name, labels), points in series.items():
            fits = name == selector.name
            for m in selector.matchers:
                value = dict(labels).get(m.label, "")
                same = re.fullmatch(m.value, value, re.S) is not None if "~" in m.op else value == m.value
                fits = fits and same == (m.op[0] != "!")
            if not fits:
                continue
            if tree is selector:
                seen = [p for p in points if at - 300 * NANO <= p[0] <= at]
                if seen and not seen[-1][2]:
                    out[tuple(sorted((("__name__", name), *labels)))] = seen[-1][1]
                continue
            seen = [(t, v) for t, v, stale in points if at - tree.window < t <= at and not stale]
            if len(seen) < 2:
                continue
            grown = seen[-1][1] - seen[0][1] + sum(a for (_, a), (_, b) in zip(seen, seen[1:]) if b < a)
            covered, gap = (seen[-1][0] - seen[0][0]) / NANO, (seen[-1][0] - seen[0][0]) / NANO / (len(seen) - 1)
            ahead, behind = (seen[0][0] - at + tree.window) / NANO, (at - seen[-1][0]) / NANO
            if grown > 0 and seen[0][1] >= 0:
                ahead = min(ahead, covered * seen[0][1] / grown)
            reach = covered + sum(gap / 2 if side >= gap * 1.1 else side for side in (ahead, behind))
            out[labels] = grown * reach / covered / (1 if tree.increase else tree.window / NANO)
        return out
    if isinstance(tree, promql.Negate):
        inner = plain(tree.arg, series, at)
        return -inner if isinstance(inner, float) else {bare(k): -v for k, v in inner.items()}
    if isinstance(tree, promql.Aggregate):
        groups = {}
        for labels, value in plain(tree.arg, series, at).items():
            key = () if tree.names is None else picked(labels, tree.names) if tree.include else bare(labels, *tree.names)
            groups.setdefault(key, []).append(value)
        fold = {"sum": sum, "avg": lambda v: sum(v) / len(v), "count": lambda v: float(len(v)), "min": min, "max": max}[tree.op]
        return {k: fold(v) for k, v in groups.items()}
    if isinstance(tree, promql.Quantile):
        q, groups = plain(tree.q, series, at), {}
        for labels, value in plain(tree.arg, series, at).items():
            groups.setdefault(bare(labels, "le"), []).append((float(dict(labels)["le"].replace("+Inf", "inf")), value))
        out = {}
        for key, buckets in groups.items():
            buckets.sort()
            for i in range(1, len(buckets)):
                buckets[i] = (buckets[i][0], max(buckets[i][1], buckets[i - 1][1]))
            rank = q * buckets[-1][1]
            at_ = next((i for i, (_, c) in enumerate(buckets[:-1]) if c >= rank), len(buckets) - 1)
            low, below = buckets[at_ - 1] if at_ else (0.0, 0.0)
            if buckets[-1][1] <= 0:
                out[key] = math.nan
            else:
                out[key] = low if at_ == len(buckets) - 1 else low + (buckets[at_][0] - low) * (rank - below) / (buckets[at_][1] - below) if buckets[at_][1] > below else math.nan
        return out
    left, right = plain(tree.left, series, at), plain(tree.right, series, at)
    test = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}.get(tree.op)

    def value(a, b):
        if test:
            return float(test(a, b))
        if tree.op == "/":
            return a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
        return {"+": a + b, "-": a - b, "*": a * b}[tree.op]

    if isinstance(left, float) and isinstance(right, float):
        return value(left, right)
    if isinstance(left, float) or isinstance(right, float):
        vector = right if isinstance(left, float) else left
        pairs = [(k, v, *((left, v) if isinstance(left, float) else (v, right))) for k, v in vector.items()]
        if test and not tree.as_bool:
            return {k: v for k, v, a, b in pairs if test(a, b)}
        return {bare(k): value(a, b) for k, v, a, b in pairs}
    on = lambda k: bare(k) if tree.names is None else picked(k, tree.names) if tree.include else bare(k, *tree.names)
    others = {on(k): v for k, v in right.items()}
    out = {}
    for k, a in left.items():
        if on(k) in others:
            b = others[on(k)]
            if not test or tree.as_bool:
                out[bare(on(k))] = value(a, b)
            elif test(a, b):
                out[k if tree.names is None else on(k)] = a
    return out


EXPRESSIONS = (
    "served", "-load", "load * 2 + 1", "10 / load", "load >= 0", "0 <= bool load", "served{node!='n2'}", 'served{zone=~"n.*", node=~"n[12]"}', "served{rack=''}", "served{zone!~'no.*'}",
    "rate(served[2m])", "increase(served[90s])", "rate(dropped[10m]) * 60", "sum(served)", "avg by (zone) (load)", "max without (node) (rate(served[3m]))", "min by (node) (served)", "count(load > 1)", "sum by (zone, node) (load) - load",
    "dropped / served", "dropped / on(zone, node) served", "served - ignoring(rack) dropped", "served > dropped", "served == bool dropped", "sum by (zone) (rate(dropped[5m])) / sum by (zone) (rate(served[5m]))", "increase(served[4m]) > 5 + 3 * 2",
    "histogram_quantile(0.3, wait_bucket)", "histogram_quantile(0.8, sum by (le) (increase(wait_bucket[2m])))", "histogram_quantile(1 - 0.05, rate(wait_bucket[100s]))", "(served + dropped) * (2 - 1)",
)


@pytest.fixture(scope="module", params=[1, 2])
def corpus(spark, request):
    made = made_points(request.param)
    series = {}
    for name, labels, t, value, stale in made:
        series.setdefault((name, tuple(sorted(labels.items()))), []).append((t, value, stale))
    df = spark.createDataFrame([(name, labels, t, i, value, stale) for i, (name, labels, t, value, stale) in enumerate(made)], "name string, labels map<string,string>, t long, cursor long, value double, stale boolean")
    return df.cache(), series


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_equals_the_plain_evaluator(corpus, text):
    points, series = corpus
    grid = promql.Grid(83 * NANO, 97 * NANO, 8)
    got = {(r.k, tuple(sorted(r.labels.items()))): r.value for r in promql.evaluate(text, points, grid).collect()}
    tree = promql.parse(text)
    want = {(k, labels): v for k in range(grid.count) for labels, v in plain(tree, series, grid.start + k * grid.step).items()}
    assert want and got.keys() == want.keys()
    for key, value in want.items():
        assert math.isclose(got[key], value, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(got[key]) and math.isnan(value)), key


def test_scalars():
    value = lambda t: promql.scalar(promql.parse(t))
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(f"{rng.randint(1, 9)} {rng.choice('+-*/')}" for _ in range(rng.randint(1, 6))) + f" {rng.randint(1, 9)}"
        assert math.isclose(value(text), eval(text), rel_tol=1e-12, abs_tol=1e-12)
    assert value("7 >= bool 7") == 1 and value("4 < 3") == 4 and value("5 / (2 - 2)") == math.inf and math.isnan(value("(1 - 1) / 0"))


REFUSED = (
    "max_over_time(load[1h])", "load offset 3d", "rate(served[10m:1m])", "load unless served", "served and load", "topk(2, load)", "load + on(node) group_right served", "load @ 77", "served[3m]", "increase(load)", "rate(served)", "load load",
    "{zone='north'}", "load{zone==\"x\"}", "load{zone=~'['}", "load{zone='x'", "load{zone}", "avg(3)", "sum by zone (load)", "", "  ", "'word'", "4 > bool", "3 != bool load bool", "((load)", "-" * 60 + "load", "2 *" * 140 + " 2", "load{a='" + "x" * 17_000 + "'}",
)


@pytest.mark.parametrize("text", REFUSED, ids=range(len(REFUSED)))
def test_refused(text):
    with pytest.raises(promql.PromError):
        promql.parse(text)


def test_duplicate_match_is_an_error(corpus):
    with pytest.raises(Exception, match="one-to-one"):
        promql.evaluate("load + on(zone) load", corpus[0], promql.Grid(180 * NANO, NANO, 1)).collect()


def test_look_back_is_closed_and_stale_ends_a_series(spark):
    rows = [("g", {}, 0, 0, 1.0, False), ("s", {}, 0, 0, 1.0, False), ("s", {}, 60 * NANO, 1, 0.0, True)]
    p = spark.createDataFrame(rows, "name string, labels map<string,string>, t long, cursor long, value double, stale boolean")
    at = lambda name, s: promql.evaluate(name, p, promql.Grid(s, NANO, 1)).count()
    assert at("g", 300 * NANO) == 1 and at("g", 300 * NANO + 1) == 0 and at("s", 59 * NANO) == 1 and at("s", 60 * NANO) == 0


def test_delta_windows_must_tile(spark):
    from heliograph.operators import steps

    rows = [("d", i, (i + 1) * 10 * NANO, i * 10 * NANO, 2.0, False) for i in range(6)]
    p = spark.createDataFrame(rows, "key string, cursor long, t long, start_time long, value double, stale boolean")
    got = steps.delta_change(p, ["key"], 60 * NANO, NANO, 1, 30 * NANO, increase=True).collect()
    assert got[0].value == 6
    with pytest.raises(Exception, match="tile"):
        steps.delta_change(p.where("cursor <> 4"), ["key"], 60 * NANO, NANO, 1, 30 * NANO, increase=True).collect()


def test_random_text_never_crashes():
    import random

    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice(["cpu", "sum", "by", "(", ")", "{", "}", "[5m]", "+", "-", ">", "bool", "1", "'x'", "=", "=~", ",", " ", "rate", "on", "\\"]) for _ in range(rng.randint(0, 12)))
        try:
            promql.parse(text)
        except promql.PromError:
            pass


def test_label_names(spark):
    df = spark.createDataFrame([({"a.b": "1", "c": "2"},)], "labels map<string,string>")
    assert df.select(promql.normalized_labels(F.col("labels")).alias("x")).first().x == {"a_b": "1", "c": "2"}
    with pytest.raises(Exception, match="collide"):
        spark.createDataFrame([({"a.b": "1", "a_b": "2"},)], "labels map<string,string>").select(promql.normalized_labels(F.col("labels"))).collect()
