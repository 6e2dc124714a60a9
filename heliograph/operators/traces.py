"""Trace operators: latest span versions, gaps and roots, critical paths, cycles, search, correlation."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.sources.tables import written

KEY = ["project", "trace_id"]


def valid(spans: DataFrame) -> DataFrame:
    """Spans that end no earlier than they start; a blank operation is the span's id."""
    return spans.where("stop >= start").withColumn("operation", F.when(F.trim("operation") == "", F.col("span_id")).otherwise(F.coalesce("operation", "span_id")))


MAX_SPANS = 100_000


def newest(spans: DataFrame, most: int = MAX_SPANS) -> DataFrame:
    """The `most` deliveries of largest cursor, and any that share the last one's cursor.

    Only cursors are sorted; the rows are filtered by the least that stays.
    """
    least = spans.select("cursor").orderBy(F.col("cursor").desc()).limit(most).agg(F.min("cursor")).first()[0]
    return spans.where(F.col("cursor") >= F.lit(least))


def latest(spans: DataFrame) -> DataFrame:
    """The delivery of largest cursor of each span, and whether there were others (`conflict`)."""
    rest = [c for c in spans.columns if c not in (*KEY, "span_id")]
    got = spans.groupBy(*KEY, "span_id").agg(F.max_by(F.struct(*rest), "cursor").alias("s"), (F.count("*") > 1).alias("conflict"))
    return got.select(*KEY, "span_id", "s.*", "conflict")


def with_parents(spans: DataFrame) -> DataFrame:
    """Latest spans with `missing`: the parent is named but absent; `root`: no parent or an absent one.

    Parents are looked up by a join: a row never carries its trace's ids.
    """
    ids = spans.select(*KEY, F.col("span_id").alias("parent_id"), F.lit(True).alias("_there"))
    named = F.coalesce(F.col("parent_id"), F.lit("")) != ""
    absent = named & F.col("_there").isNull()
    return spans.join(ids, [*KEY, "parent_id"], "left").withColumn("missing", absent).withColumn("root", ~named | absent).drop("_there")


def gaps(spans: DataFrame) -> DataFrame:
    """trace, gap text: missing parents and conflicting spans."""
    found = F.array_compact(F.array(F.when(F.col("missing"), F.concat_ws(":", F.lit("missing_parent"), "span_id", "parent_id")), F.when(F.col("conflict"), F.concat(F.lit("conflicting_span:"), F.col("span_id")))))
    return spans.select(*KEY, F.explode(found).alias("gap"))


def _list(c: str, condition: str | None = None) -> Column:
    return F.sort_array(F.collect_list(F.when(F.expr(condition), F.col(c)) if condition else F.col(c)))


def _cycles(pdf: pd.DataFrame) -> list[list[str]]:
    """Each cycle of parent pointers once, its spans in order."""
    parent = {s: p for s, p in zip(pdf["span_id"], pdf["parent_id"])}
    state: dict[str, int] = {}
    out = []
    for origin in sorted(parent):
        trail, at = [], origin
        while at in parent and at not in state:
            state[at] = 1
            trail.append(at)
            at = parent[at]
        if at in parent and state.get(at) == 1 and at in trail:
            out.append(sorted(trail[trail.index(at) :]))
        for s in trail:
            state[s] = 2
    return sorted(out)


def _unreached(spans: DataFrame) -> DataFrame:
    """The spans whose parents lead to no root: those in cycles, and those that hang on them.

    Every span points at an ancestor, its parent first.  In each round the ones
    whose ancestor hangs on a root go, and the others point as far again as their
    ancestor does; a chain of n spans is gone after log2(n) rounds.
    """
    rows = written(spans.where("NOT root").select(*KEY, "span_id", F.col("parent_id").alias("up")), "unreached")
    left = rows.count()
    longest = spans.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):
        if not left:
            break
        above = rows.select(*KEY, F.col("span_id").alias("up"), F.col("up").alias("far"))
        rows = written(rows.join(above, [*KEY, "up"]).select(*KEY, "span_id", F.col("far").alias("up")), "unreached")
        left = rows.count()
    return rows.select(*KEY, "span_id")


def cycles(spans: DataFrame) -> DataFrame:
    """trace, cycle array, of with_parents() spans: each cycle of parents once, its spans in order.

    Spans that a root reaches are peeled off by joins; what is left, few traces
    if any, goes to a function by trace.
    """
    suspect = spans.select(*KEY, "span_id", "parent_id").join(_unreached(spans), [*KEY, "span_id"], "left_semi")

    def by_trace(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _cycles(pdf)
        return pd.DataFrame({"project": [key[0]] * len(found), "trace_id": [key[1]] * len(found), "cycle": found}, dtype=object)

    return suspect.groupBy(*KEY).applyInPandas(by_trace, "project string, trace_id string, cycle array<string>")


def best_path(spans: list[tuple[str, str | None, int]]) -> tuple[int, list[str]]:
    """Largest sum of durations down from a root, and its path, of (span, parent, duration) rows of one trace.

    Without a root every span is a candidate.  Ties go to the smaller path; the
    paths of siblings differ in their first span.  No recursion, and a span
    keeps its best child only.
    """
    parent = {s: p for s, p, _ in spans}
    own = {s: d for s, _, d in spans}
    children: dict[str, list[str]] = {}
    for s, p in parent.items():
        if p in own:
            children.setdefault(p, []).append(s)
    best: tuple[int, list[str]] | None = None
    for root in sorted(s for s, p in parent.items() if p not in own) or sorted(own):
        done: dict[str, tuple[int, str | None]] = {}
        stack, trail = [(root, False)], set()
        while stack:
            s, back = stack.pop()
            if back:
                trail.discard(s)
                below = min(((-done[c][0], c) for c in children.get(s, ()) if c in done), default=(0, None))
                done[s] = (own[s] - below[0], below[1])
            else:
                trail.add(s)
                stack.append((s, True))
                stack += [(c, False) for c in children.get(s, ()) if c not in trail]
        if best is None or done[root][0] > best[0]:
            path, at = [], root
            while at is not None:
                path.append(at)
                at = done[at][1]
            best = (done[root][0], path)
    return best or (0, [])


def critical_path(spans: DataFrame) -> DataFrame:
    """trace, path array, length: the largest sum of durations from a root to a leaf; ties go to the smaller path.

    Traces may have any depth.  Where a trace has no root, every span is a
    candidate and a path ends before it would repeat a span.  A trace's spans come together by one shuffle and a sort; a function walks
    the sorted rows and holds one trace at a time.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["project", "trace_id", "path", "length"])
            out.clear()
            return done

        for batch in batches:
            for project, trace, span, parent, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (project, trace) != key:
                    if held:
                        length, path = best_path(held)
                        out.append((*key, path, length))
                    key, held = (project, trace), []
                held.append((span, parent, own))
            if len(out) > 5_000:
                yield flush()
        if held:
            length, path = best_path(held)
            out.append((*key, path, length))
        if out:
            yield flush()

    rows = spans.select(*KEY, "span_id", "parent_id", (F.col("stop") - F.col("start")).alias("own"))
    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(walk, "project string, trace_id string, path array<string>, length long")


def summary(spans: DataFrame) -> DataFrame:
    """One row a trace of with_parents() spans: counts, duration, roots, gaps, partial (cycles aside)."""
    return spans.groupBy(*KEY).agg(
        F.count("*").alias("n_spans"),
        (F.max("stop") - F.min("start")).alias("duration"),
        F.array_join(_list("span_id", "root"), ",").alias("roots"),
        F.sum(F.col("missing").cast("long")).alias("missing"),
        F.sum(F.col("conflict").cast("long")).alias("conflicts"),
        (F.max((F.col("missing") | F.col("conflict")).cast("int")) + (1 - F.max(F.col("root").cast("int"))) > 0).alias("partial"),
    )


def search(spans: DataFrame, *, environment: str | None = None, service: str | None = None, operation: str | None = None, status: str | None = None, attributes: dict[str, str] | None = None, start: int | None = None, stop: int | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Traces whose spans in the time range meet every predicate, each by any span; durations are of the whole trace."""
    inside: list[Column] = [F.lit(True)]
    if environment is not None:
        inside.append(F.col("environment") == environment)
    if start is not None:
        inside.append(F.col("stop") >= start)
    if stop is not None:
        inside.append(F.col("start") < stop)
    within = functools.reduce(operator.and_, inside)
    wanted = {"service": service, "operation": operation}
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if status is not None:
        tests.append(F.upper("status") == status.upper())
    tests += [F.try_element_at("attributes", F.lit(k)) == v for k, v in (attributes or {}).items()]
    any_of = [F.bool_or(F.coalesce(within & t, F.lit(False))).alias(f"_t{i}") for i, t in enumerate([F.lit(True), *tests])]
    out = spans.groupBy(*KEY).agg(*any_of, (F.max("stop") - F.min("start")).alias("duration"), F.count("*").alias("n_spans"))
    for i in range(len(any_of)):
        out = out.where(F.col(f"_t{i}"))
    if least is not None:
        out = out.where(F.col("duration") >= least)
    if most is not None:
        out = out.where(F.col("duration") <= most)
    return out.select(*KEY, "duration", "n_spans")


def correlation_ids(spans: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """trace, kind, ids: distinct ids of each kind in order; null ids don't count."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in columns))).alias("x")
    each = spans.select(*KEY, kinds).where("x.id IS NOT NULL").select(*KEY, "x.kind", "x.id").distinct()
    return each.groupBy(*KEY, "kind").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
