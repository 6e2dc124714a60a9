"""The metric expression language: lexer, precedence parser, and compilation to DataFrames for all steps at once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.values import NANO, divide, identity, max_value, min_value
from heliograph.operators import steps

MAX_BYTES, MAX_DEPTH, MAX_OPERATORS = 16 * 1024, 32, 128
MAX_STEPS, MAX_EVALUATIONS = 11_000, 1_000_000
AGGREGATES = ("sum", "avg", "count", "min", "max")
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")
#: Binding strength of the binary operators that exist here.
STRENGTH = {"*": 3, "/": 3, "+": 2, "-": 2} | dict.fromkeys(COMPARISONS, 1)
UNITS = {"ms": NANO // 1000, "s": NANO, "m": 60 * NANO, "h": 3600 * NANO, "d": 86_400 * NANO, "w": 604_800 * NANO, "y": 31_536_000 * NANO}


class PromError(ValueError):
    pass


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    value: str


@dataclass(frozen=True)
class Selector:
    name: str | None
    matchers: tuple[Matcher, ...]


@dataclass(frozen=True)
class Change:
    selector: Selector
    window: int
    increase: bool


@dataclass(frozen=True)
class Negate:
    arg: object


@dataclass(frozen=True)
class Aggregate:
    op: str
    arg: object
    names: tuple[str, ...] | None
    include: bool


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    names: tuple[str, ...] | None
    include: bool
    as_bool: bool


@dataclass(frozen=True)
class Quantile:
    q: object
    arg: object


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<duration>(?:\d+(?:ms|[smhdwy]))+(?![A-Za-z0-9_]))|(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_:][A-Za-z0-9_:]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<op>==|!=|=~|!~|>=|<=|[-+*/^%<>=(){}\[\],@:])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise PromError(f"unexpected character at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


def duration(text: str) -> int:
    parts = re.findall(r"(\d+)(ms|[smhdwy])", text)
    if not parts or "".join(a + b for a, b in parts) != text or sum(int(a) for a, _ in parts) == 0:
        raise PromError(f"invalid duration {text!r}")
    return sum(int(a) * UNITS[b] for a, b in parts)


def _unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c[0].isdigit():
            return chr(int(c, 8))
        if c not in _ESCAPES:
            raise PromError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", one, text[1:-1])


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth, self.operators = _lex(text), 0, 0, 0

    def peek(self) -> str:
        kind, text = self.tokens[self.at]
        return text if kind in ("op", "name") else kind

    def take(self, *wanted: str) -> str:
        kind, text = self.tokens[self.at]
        if wanted and text not in wanted and kind not in wanted:
            raise PromError(f"expected {' or '.join(wanted)}, found {text or kind!r}")
        self.at += 1
        return text

    def expression(self, least: int = 0):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise PromError("expression is nested too deeply")
        left = self.unary()
        while True:
            op = self.peek()
            if op in ("and", "or", "unless", "%", "^", "atan2"):
                raise PromError(f"operator {op} is not supported")
            if op not in STRENGTH or STRENGTH[op] < least:
                break
            self.take()
            self.operators += 1
            if self.operators > MAX_OPERATORS:
                raise PromError("too many operators")
            as_bool = names = None
            include = False
            if self.peek() == "bool":
                self.take()
                if op not in COMPARISONS:
                    raise PromError("bool goes with comparisons only")
                as_bool = True
            if self.peek() in ("on", "ignoring"):
                include = self.take() == "on"
                names = self.names()
            if self.peek() in ("group_left", "group_right"):
                raise PromError("many-to-one matching is not supported")
            left = Binary(op, left, self.expression(STRENGTH[op] + 1), names, include, bool(as_bool))
        self.depth -= 1
        return left

    def unary(self):
        if self.peek() in ("-", "+"):
            self.operators += 1
            if self.operators > MAX_OPERATORS:
                raise PromError("too many operators")
            minus = self.take() == "-"
            # A sign binds tighter than * and /.
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise PromError("expression is nested too deeply")
            arg = self.unary()
            self.depth -= 1
            return (Number(-arg.value) if isinstance(arg, Number) else Negate(arg)) if minus else arg
        return self.primary()

    def names(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.take("name"))
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return tuple(out)

    def primary(self):
        kind, text = self.tokens[self.at]
        if text == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return self.plain(inner)
        if kind == "number":
            self.take()
            return self.plain(Number(float(int(text, 16)) if text.startswith("0x") else float(text)))
        if kind == "duration":
            raise PromError("a duration stands in brackets only")
        following = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else ""
        if kind == "name" and text.lower() in ("inf", "nan") and following not in ("{", "("):
            self.take()
            return Number(float(text))
        if kind == "name" and text in AGGREGATES and following in ("(", "by", "without"):
            return self.plain(self.aggregate())
        if kind == "name" and following == "(":
            return self.plain(self.call())
        if kind == "name" or text == "{":
            return self.plain(self.selector())
        raise PromError(f"unexpected {text or kind!r}")

    def plain(self, node):
        """What stands after an operand must not be a range, an offset or an @ modifier."""
        if self.peek() in ("[", "@", "offset"):
            raise PromError(f"{self.peek()} is not supported here")
        return node

    def aggregate(self) -> Aggregate:
        op, names, include = self.take(), None, False
        if self.peek() in ("by", "without"):
            include = self.take() == "by"
            names = self.names()
        self.take("(")
        arg = self.expression()
        self.take(")")
        if names is None and self.peek() in ("by", "without"):
            include = self.take() == "by"
            names = self.names()
        return Aggregate(op, arg, names, include)

    def call(self):
        name = self.take()
        self.take("(")
        if name in ("rate", "increase"):
            selector = self.selector()
            self.take("[")
            window = duration(self.take("duration"))
            self.take("]")
            self.plain(None)
            self.take(")")
            return Change(selector, window, name == "increase")
        if name == "histogram_quantile":
            q = self.expression()
            self.take(",")
            arg = self.expression()
            self.take(")")
            if is_scalar(arg) or not is_scalar(q):
                raise PromError("histogram_quantile takes a scalar and a vector")
            return Quantile(q, arg)
        raise PromError(f"function {name} is not supported")

    def selector(self) -> Selector:
        name, matchers = None, []
        if self.tokens[self.at][0] == "name":
            name = self.take()
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                label, op = self.take("name"), self.take("=", "!=", "=~", "!~")
                if self.tokens[self.at][0] != "string":
                    raise PromError("a matcher compares with a string")
                value = _unquote(self.take())
                if label == "__name__" and op == "=":
                    if name is not None:
                        raise PromError("the name is given twice")
                    name = value
                else:
                    matchers.append(Matcher(label, op, value))
                if self.peek() == "or":
                    raise PromError("or selectors are not supported")
                if self.peek() != "}":
                    self.take(",")
            self.take("}")
        if not name:
            raise PromError("a selector needs a metric name")
        for m in matchers:
            if m.op in ("=~", "!~"):
                try:
                    re.compile(m.value)
                except re.error as e:
                    raise PromError(f"invalid pattern: {e}") from e
        return Selector(name, tuple(matchers))


def parse(text: str):
    if len(text.encode()) > MAX_BYTES:
        raise PromError("expression is too long")
    parser = _Parser(text)
    tree = parser.expression()
    parser.take("end")
    _check(tree)
    return tree


def _check(tree) -> None:
    if isinstance(tree, (Aggregate, Negate)):
        if isinstance(tree, Aggregate) and is_scalar(tree.arg):
            raise PromError("an aggregate takes a vector")
        _check(tree.arg)
    elif isinstance(tree, Quantile):
        _check(tree.arg)
    elif isinstance(tree, Binary):
        both = is_scalar(tree.left) or is_scalar(tree.right)
        if tree.names is not None and both:
            raise PromError("label matching takes two vectors")
        _check(tree.left)
        _check(tree.right)


def is_scalar(tree) -> bool:
    if isinstance(tree, Number):
        return True
    return is_scalar(tree.arg) if isinstance(tree, Negate) else isinstance(tree, Binary) and is_scalar(tree.left) and is_scalar(tree.right)


def selectors(tree) -> list[tuple[Selector, int]]:
    """All selectors with the look-back that each needs."""
    if isinstance(tree, Selector):
        return [(tree, steps.LOOKBACK)]
    if isinstance(tree, Change):
        return [(tree.selector, tree.window)]
    if isinstance(tree, (Aggregate, Negate, Quantile)):
        return selectors(tree.arg)
    return selectors(tree.left) + selectors(tree.right) if isinstance(tree, Binary) else []


def _arith(op: str, a: float, b: float) -> float:
    if op == "/":
        if b == 0:
            return float("nan") if a == 0 or a != a else float("inf") * (1 if a > 0 else -1) * (1 if str(b)[0] != "-" else -1)
        return a / b
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def scalar(tree) -> float:
    """A scalar's value; a comparison of scalars without bool yields the left one."""
    if isinstance(tree, Number):
        return tree.value
    if isinstance(tree, Negate):
        return -scalar(tree.arg)
    a, b = scalar(tree.left), scalar(tree.right)
    if tree.op in COMPARISONS:
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[tree.op]) if tree.as_bool else a
    return _arith(tree.op, a, b)


def _column(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return divide(a, b)
    return {"+": a + b, "-": a - b, "*": a * b, "==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... in nanoseconds."""

    start: int
    step: int
    count: int

    def __post_init__(self):
        if not 1 <= self.count <= MAX_STEPS or self.step <= 0:
            raise PromError("1 to 11000 steps of a positive width")


def _without(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names))


def _select(labels: Column, names: tuple[str, ...] | None, include: bool) -> Column:
    """The labels that matching or grouping keeps."""
    if names is None:
        return _without(labels, ("__name__",))
    if include:
        return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else F.map_filter(labels, lambda k, _: F.lit(False))
    return _without(labels, ("__name__", *names))


def select_points(points: DataFrame, selector: Selector) -> DataFrame:
    """Points of the series a selector names; a missing label is the empty text, patterns are anchored."""
    out = points.where(F.col("name") == selector.name)
    for m in selector.matchers:
        value = F.coalesce(F.try_element_at("labels", F.lit(m.label)), F.lit("")) if m.label != "__name__" else F.col("name")
        test = value.rlike(rf"(?s)^(?:{m.value})\z") if "~" in m.op else value == m.value
        out = out.where(~test if m.op[0] == "!" else test)
    return out


def compile_vector(tree, points: DataFrame, grid: Grid, temporality: str = "cumulative") -> DataFrame:
    """k, key, labels, value: one row a step and series.

    `points` has name, labels map<string, string>, t, cursor, value, stale; `key`
    is the canonical text of the labels, so that no shuffle runs on a map.
    """
    if isinstance(tree, (Selector, Change)):
        selector = tree if isinstance(tree, Selector) else tree.selector
        look = steps.LOOKBACK if isinstance(tree, Selector) else tree.window
        some = select_points(points, selector).where((F.col("t") <= grid.start + grid.step * (grid.count - 1)) & (F.col("t") > grid.start - look - 1))
        some = some.withColumn("key", identity(F.col("labels"))) if "key" not in points.columns else some
        if isinstance(tree, Selector):
            seen = steps.instant(some, ["key"], grid.start, grid.step, grid.count)
        elif temporality == "delta":
            seen = steps.delta_change(some, ["key"], grid.start, grid.step, grid.count, tree.window, increase=tree.increase)
        else:
            seen = steps.window_change(some, ["key"], grid.start, grid.step, grid.count, tree.window, increase=tree.increase)
        labels = _labels_of(F.col("key"))
        if isinstance(tree, Selector):
            labels = F.map_concat(F.create_map(F.lit("__name__"), F.lit(selector.name)), labels)
        return _keyed(seen.select("k", labels.alias("labels"), "value"))
    if isinstance(tree, Negate):
        inner = compile_vector(tree.arg, points, grid, temporality)
        return _keyed(inner.select("k", _without(F.col("labels"), ("__name__",)).alias("labels"), (-F.col("value")).alias("value")))
    if isinstance(tree, Aggregate):
        inner = compile_vector(tree.arg, points, grid, temporality)
        kept = F.map_filter("labels", lambda k, _: F.lit(False)) if tree.names is None else _select(F.col("labels"), tree.names, tree.include)
        grouped = inner.select("k", identity(kept).alias("key"), "value").groupBy("k", "key")
        v = F.col("value")
        out = {"sum": F.sum(v), "avg": F.avg(v), "count": F.count("*").cast("double"), "min": min_value(v), "max": max_value(v)}[tree.op]
        return grouped.agg(out.alias("value")).select("k", "key", _labels_of(F.col("key")).alias("labels"), "value")
    if isinstance(tree, Quantile):
        return _quantile(scalar(tree.q), compile_vector(tree.arg, points, grid, temporality))
    if not isinstance(tree, Binary) or is_scalar(tree):
        raise PromError("a vector is needed here")
    comparison = tree.op in COMPARISONS
    drop = not comparison or tree.as_bool
    if is_scalar(tree.left) or is_scalar(tree.right):
        other = F.lit(scalar(tree.left if is_scalar(tree.left) else tree.right))
        inner = compile_vector(tree.right if is_scalar(tree.left) else tree.left, points, grid, temporality)
        a, b = (other, F.col("value")) if is_scalar(tree.left) else (F.col("value"), other)
        return _applied(inner, tree, _column(tree.op, a, b), F.col("value"), drop)
    left = compile_vector(tree.left, points, grid, temporality)
    right = compile_vector(tree.right, points, grid, temporality)
    # A key that comes twice on a side is an error, matched or not: both checks ride on the partial aggregates.
    twice = F.raise_error(F.lit("an operand has several series for a one-to-one match"))
    match = identity(_select(F.col("labels"), tree.names, tree.include)).alias("m")
    lone = lambda df, name: df.select("k", match, F.struct("labels", "value").alias("s")).groupBy("k", "m").agg(F.count("*").alias("n"), F.any_value("s").alias(name)).withColumn(name, F.when(F.col("n") == 1, F.col(name)).otherwise(F.when(twice.cast("boolean"), F.col(name)))).drop("n")
    both = lone(left, "l").join(lone(right, "r"), ["k", "m"])
    labels = F.col("l.labels") if tree.names is None else _select(F.col("l.labels"), tree.names, tree.include)
    drop = drop or (tree.names is not None and tree.include)
    out = both.select("k", labels.alias("labels"), F.col("l.value").alias("value"), F.col("r.value").alias("other"))
    return _applied(out, tree, _column(tree.op, F.col("value"), F.col("other")), F.col("value"), drop)


def _applied(df: DataFrame, tree: Binary, result: Column, kept: Column, drop: bool) -> DataFrame:
    """A comparison filters and keeps the vector's value, with bool it gives 0 or 1; arithmetic replaces the value."""
    if tree.op in COMPARISONS and not tree.as_bool:
        df, result = df.where(result), kept
    labels = _without(F.col("labels"), ("__name__",)) if drop else F.col("labels")
    return _keyed(df.select("k", labels.alias("labels"), result.cast("double").alias("value")))


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("k", identity(F.col("labels")).alias("key"), "labels", "value")


def _labels_of(key: Column) -> Column:
    """The map that identity() wrote as text."""
    entries = F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<array<string>>")
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e[0].alias("key"), e[1].alias("value"))))


def _quantile(q: float, buckets: DataFrame) -> DataFrame:
    """Quantile of cumulative buckets by labels without le and name."""
    bound = F.try_element_at("labels", F.lit("le"))
    b = buckets.where(bound.isNotNull()).select("k", identity(_without(F.col("labels"), ("__name__", "le"))).alias("key"), F.when(bound == "+Inf", F.lit(float("inf"))).otherwise(bound.cast("double")).alias("le"), "value")
    wrong = F.isnan("le") | F.isnan("value") | (F.col("value") < 0) | (F.col("value") == float("inf"))
    b = b.select("k", "key", "le", F.when(wrong, F.raise_error(F.lit("invalid histogram bucket")).cast("double")).otherwise(F.col("value")).alias("value"))
    # A group is the bounds of one histogram: small, and summed by bound before it is gathered.
    sums = b.groupBy("k", "key", "le").agg(F.sum("value").alias("c"))
    per = sums.groupBy("k", "key").agg(F.array_sort(F.collect_list(F.struct("le", "c"))).alias("b"))
    zero = F.struct(F.lit(0.0).alias("top"), F.expr("cast(array() AS array<struct<le: double, c: double>>)").alias("out"))
    near = lambda top, c: F.abs(c - top) <= 1e-12 * (F.abs(c) + F.abs(top))
    fixed = F.aggregate("b", zero, lambda acc, x: F.struct(F.when((x["c"] < acc["top"]) | near(acc["top"], x["c"]), acc["top"]).otherwise(x["c"]).alias("top"), F.concat(acc["out"], F.array(F.struct(x["le"].alias("le"), F.when((x["c"] < acc["top"]) | near(acc["top"], x["c"]), acc["top"]).otherwise(x["c"]).alias("c")))).alias("out")))
    per = per.withColumn("f", fixed["out"]).withColumn("n", F.size("b")).withColumn("total", F.element_at("f", -1)["c"]).withColumn("rank", F.lit(q) * F.col("total"))
    reached = F.filter(F.transform("f", lambda x, i: F.struct(i.alias("i"), x["c"].alias("c"))), lambda x: (x["c"] >= F.col("rank")) & (x["i"] < F.col("n") - 1))
    per = per.withColumn("i", F.coalesce(F.try_element_at(reached, F.lit(1))["i"], F.col("n") - 1))
    le, c = (lambda i: F.try_element_at("f", i + 1)["le"]), (lambda i: F.try_element_at("f", i + 1)["c"])
    i = F.col("i")
    prev = F.greatest(i, F.lit(1)) - 1
    low, below = F.when(i > 0, le(prev)).otherwise(0.0), F.when(i > 0, c(prev)).otherwise(0.0)
    inside = low + (le(i) - low) * divide(F.col("rank") - below, c(i) - below)
    nan = F.lit(float("nan"))
    value = (
        F.lit(float("-inf")) if q < 0 else F.lit(float("inf")) if q > 1 else nan if q != q
        else F.when((F.col("n") < 2) | (F.element_at("f", -1)["le"] != float("inf")) | (F.col("total") <= 0), nan)
        .when(i == F.col("n") - 1, le(prev)).when((i == 0) & (le(i) <= 0), le(i)).otherwise(inside)
    )
    return per.select("k", "key", _labels_of(F.col("key")).alias("labels"), value.alias("value"))


def evaluate(text: str, points: DataFrame, grid: Grid, temporality: str = "cumulative") -> DataFrame | float:
    """A float for a scalar expression, else (k, key, labels, value) rows."""
    tree = parse(text)
    return scalar(tree) if is_scalar(tree) else compile_vector(tree, points, grid, temporality)


def normalized_labels(labels: Column) -> Column:
    """Label names with only [A-Za-z0-9_:]; two that become one are an error."""
    renamed = F.transform_keys(labels, lambda k, _: F.regexp_replace(k, "[^A-Za-z0-9_:]", "_"))
    names = F.transform(F.map_keys(labels), lambda k: F.regexp_replace(k, "[^A-Za-z0-9_:]", "_"))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), renamed).otherwise(F.raise_error(F.lit("label names collide")).cast("map<string,string>"))


def label_set(name: Column, resource: Column, attributes: Column) -> Column:
    """Labels of a series in the small dialect: name, resource without the SDK's name, attributes on top; dots stay."""
    infra = F.map_filter(resource, lambda k, _: (k != "telemetry.sdk.name") & ~F.array_contains(F.map_keys(attributes), k) & (k != "__name__"))
    own = F.map_filter(attributes, lambda k, _: k != "__name__")
    return F.map_concat(F.create_map(F.lit("__name__"), F.coalesce(F.try_element_at(attributes, F.lit("__name__")), name)), infra, own)


def merged_series(points: DataFrame) -> DataFrame:
    """Points once for each (name, labels, t): what several selectors load twice goes, different values at a time are an error."""
    keyed = points if "key" in points.columns else points.withColumn("key", identity(F.col("labels")))
    rest = F.struct("value", "stale")
    per = keyed.groupBy("name", "key", "t").agg(F.any_value("labels").alias("labels"), F.min("cursor").alias("cursor"), F.min(rest).alias("low"), F.max(rest).alias("high"))
    clash = F.raise_error(F.lit("metric series conflict at a time")).cast("double")
    return per.select("name", "key", "labels", "t", "cursor", F.when(F.col("low") == F.col("high"), F.col("low.value")).otherwise(clash).alias("value"), F.col("low.stale").alias("stale"))
