"""The request interface: versioned queries over logs, metrics and traces, metric expressions, and jobs.

A Store names the engine's tables; each request becomes one lazy plan, of which
a page (at most 1000 rows) is collected.
"""

from __future__ import annotations

import base64
import json
import re
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.values import NANO, identity, plain_number
from heliograph.operators import filters, logs, metrics, steps, traces
from heliograph.plans import promql

MAX_LIMIT, ASYNC_OVER, MAX_RUNNING = 1000, 500, 64
MAX_SERIES = 1000


class RequestError(ValueError):
    pass


@dataclass
class Response:
    data: list[dict]
    next_cursor: str | None = None
    watermark: int = 0
    partial: bool = False
    warnings: list[str] = field(default_factory=list)
    query_id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Store:
    """logs, points (name, labels, t, cursor, value, stale, project, environment) and spans tables."""

    logs: DataFrame
    points: DataFrame
    spans: DataFrame
    temporality: str = "cumulative"

    def watermark(self, table: DataFrame, project: str) -> int:
        return table.where(F.col("project") == project).agg(F.max("cursor")).first()[0] or 0


def encode_cursor(signal: str, value: str) -> str:
    return f"{signal}:{base64.urlsafe_b64encode(value.encode()).decode().rstrip('=')}"


def decode_cursor(signal: str, cursor: str | None) -> str | None:
    if cursor is None:
        return None
    kind, colon, body = cursor.partition(":")
    if not colon or kind != signal or not re.fullmatch(r"[A-Za-z0-9_-]*", body):
        raise RequestError(f"not a {signal} cursor")
    try:
        return base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode()
    except ValueError as e:
        raise RequestError("cursor can't be read") from e


def rfc3339_nanos(text: str) -> int:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)", text)
    if not m:
        raise RequestError(f"{text!r} is no RFC 3339 time")
    try:
        at = datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] in 'Zz' else m[4]}")
    except ValueError as e:
        raise RequestError(f"{text!r} is no RFC 3339 time") from e
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * NANO + int((m[3] or "").ljust(9, "0")[:9])


def seconds_nanos(text: str) -> int:
    """Decimal seconds or RFC 3339 as nanoseconds, rounded half away from zero, within 64 bits."""
    try:
        value = int((Decimal(text) * NANO).to_integral_value(ROUND_HALF_UP)) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?", text) else rfc3339_nanos(text)
    except InvalidOperation as e:
        raise RequestError(f"{text!r} is no time") from e
    if not -(1 << 63) <= value < 1 << 63:
        raise RequestError("time is out of range")
    return value


def _known(given: dict, allowed: set[str], what: str) -> None:
    if not isinstance(given, dict) or set(given) - allowed:
        raise RequestError(f"{what} has unknown fields")


def _range(request: dict) -> tuple[int | None, int | None]:
    span = request.get("time_range") or {}
    _known(span, {"start", "end"}, "time_range")
    start, stop = (None if span.get(k) is None else rfc3339_nanos(span[k]) for k in ("start", "end"))
    if start is not None and stop is not None and start >= stop:
        raise RequestError("start must be before end")
    return start, stop


_SIGNALS = {
    "logs": {"kind", "filter"},
    "metrics": {"kind", "name", "function", "step_seconds", "group_by", "filter"},
    "traces": {"kind", "service", "operation", "min_duration_ms", "max_duration_ms", "status", "attributes", "filter"},
}


def validate(request: dict) -> None:
    """A version-1 request; unknown fields are refused."""
    _known(request, {"version", "project", "environment", "time_range", "signal", "limit", "cursor", "mode"}, "request")
    if request.get("version") != 1:
        raise RequestError("version must be 1")
    for name in ("project", "environment"):
        if (name in request or name == "project") and not str(request.get(name) or "").strip():
            raise RequestError(f"{name} must not be blank")
    limit = request.get("limit", 100)
    if not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise RequestError("limit is 1 to 1000")
    if request.get("mode", "auto") not in ("auto", "sync", "async"):
        raise RequestError("unknown mode")
    _range(request)
    signal = request.get("signal")
    if not isinstance(signal, dict) or signal.get("kind") not in _SIGNALS:
        raise RequestError("unknown signal")
    _known(signal, _SIGNALS[signal["kind"]], "signal")
    try:
        if signal.get("filter") is not None:
            filters.validate(signal["filter"])
    except filters.FilterError as e:
        raise RequestError(str(e)) from e
    if signal["kind"] == "metrics":
        if signal.get("function", "raw") not in metrics.FUNCTIONS:
            raise RequestError("unknown function")
        if signal.get("step_seconds") is not None and signal["step_seconds"] <= 0:
            raise RequestError("step_seconds must be positive")
        if len(signal.get("group_by", ())) > filters.MAX_ARGS:
            raise RequestError("group_by has too many fields")
    if signal["kind"] == "traces":
        low, high = signal.get("min_duration_ms"), signal.get("max_duration_ms")
        if low is not None and high is not None and low > high:
            raise RequestError("min_duration_ms is above max_duration_ms")


def run(store: Store, request: dict) -> Response:
    """Answer a version-1 request."""
    validate(request)
    return {"logs": _logs, "metrics": _metrics, "traces": _traces}[request["signal"]["kind"]](store, request)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _logs(store: Store, request: dict) -> Response:
    """A page by cursor first, then the filter over it: the page may be empty and still lead on."""
    start, stop = _range(request)
    after = decode_cursor("logs", request.get("cursor"))
    limit = request.get("limit", 100)
    some = logs.select(store.logs, request["project"], environment=request.get("environment"), start=start, stop=stop, after=None if after is None else int(after))
    tree = request["signal"].get("filter")
    keep = F.lit(True) if tree is None else filters.compile_filter(tree, logs.document())
    found = _rows(some.withColumn("_keep", keep).orderBy("cursor").limit(limit + 1))
    more, found = len(found) > limit, found[:limit]
    cursor = encode_cursor("logs", str(found[-1]["cursor"])) if more else None
    return Response([{k: v for k, v in r.items() if k != "_keep"} for r in found if r["_keep"]], cursor, store.watermark(store.logs, request["project"]))


def _metrics(store: Store, request: dict) -> Response:
    signal, (start, stop) = request["signal"], _range(request)
    after, limit = decode_cursor("metrics", request.get("cursor")), request.get("limit", 100)
    points = store.points.where(F.col("project") == request["project"])
    for column, value in (("environment", request.get("environment")), ("name", signal.get("name"))):
        if value is not None:
            points = points.where(F.col(column) == value)
    if start is not None:
        points = points.where(F.col("t") >= start)
    if stop is not None:
        points = points.where(F.col("t") < stop)
    points = points.withColumn("labels_key", identity(F.col("labels")))
    points = points.withColumn("series_id", metrics.series_id(F.col("project"), F.col("name"), F.col("labels_key")))
    by = ["series_id", "name", "labels_key"]
    value = metrics.aggregate(points, by, store.temporality, signal.get("function", "raw"))
    counted = points.groupBy("series_id").agg(F.any_value("labels").alias("labels"), F.count("*").alias("points"))
    page = _rows(metrics.series_page(value.join(counted, "series_id"), limit, after))
    more, page = len(page) > limit, page[:limit]
    tree = signal.get("filter")
    if tree is not None and page:
        document = filters.Document({"name": ("string", F.col("name")), "value": ("double", F.col("value")), "series_id": ("string", F.col("series_id"))}, maps={"labels": F.col("labels")})
        rows = store.points.sparkSession.createDataFrame([(r["series_id"], r["name"], r["value"], r["labels"]) for r in page], "series_id string, name string, value double, labels map<string,string>")
        kept = {r.series_id for r in rows.where(filters.compile_filter(tree, document)).collect()}
    else:
        kept = {r["series_id"] for r in page}
    cursor = encode_cursor("metrics", page[-1]["series_id"]) if more else None
    return Response([{k: v for k, v in r.items() if k != "labels_key"} for r in page if r["series_id"] in kept], cursor, store.watermark(store.points, request["project"]))


def _traces(store: Store, request: dict) -> Response:
    signal, (start, stop) = request["signal"], _range(request)
    after, limit = decode_cursor("traces", request.get("cursor")), request.get("limit", 100)
    ms = lambda k: None if signal.get(k) is None else signal[k] * 1_000_000
    spans = traces.latest(traces.valid(store.spans.where(F.col("project") == request["project"])))
    found = traces.search(spans, environment=request.get("environment"), service=signal.get("service"), operation=signal.get("operation"), status=signal.get("status"), attributes=signal.get("attributes"), start=start, stop=stop, least=ms("min_duration_ms"), most=ms("max_duration_ms"))
    if signal.get("filter") is not None:
        found = found.where(filters.compile_filter(signal["filter"], filters.Document({"trace_id": ("string", F.col("trace_id")), "duration": ("long", F.col("duration")), "n_spans": ("long", F.col("n_spans"))})))
    page = _rows(metrics.series_page(found, limit, after, key="trace_id"))
    more, page = len(page) > limit, page[:limit]
    return Response(page, encode_cursor("traces", page[-1]["trace_id"]) if more else None, store.watermark(store.spans, request["project"]))


def get_trace(store: Store, project: str, trace_id: str) -> dict | None:
    """One assembled trace: spans in order, roots, gaps, cycles, critical path, duration."""
    spans = traces.with_parents(traces.latest(traces.valid(store.spans.where((F.col("project") == project) & (F.col("trace_id") == trace_id)))))
    rows = sorted(_rows(spans), key=lambda r: (r["start"], r["span_id"], r["cursor"]))
    if not rows:
        return None
    gaps = sorted([f"missing_parent:{r['span_id']}:{r['parent_id']}" for r in rows if r["missing"]] + [f"conflicting_span:{r['span_id']}" for r in rows if r["conflict"]])
    cycles = [r["cycle"] for r in _rows(traces.cycles(spans))]
    roots = sorted(r["span_id"] for r in rows if r["root"])
    length, path = traces.best_path([(r["span_id"], r["parent_id"], r["stop"] - r["start"]) for r in rows])
    return {
        "trace_id": trace_id, "spans": rows, "roots": roots, "gaps": gaps, "cycles": cycles, "critical_path": path, "critical_length": length,
        "duration": max(r["stop"] for r in rows) - min(r["start"] for r in rows), "partial": bool(gaps or cycles or not roots),
    }


def run_v2(store: Store, request: dict, now: int | None = None) -> Response:
    """A version-2 request: a metric expression or an exact log count."""
    _known(request, {"version", "project", "environment", "time_range", "signal", "step_seconds"}, "request")
    if request.get("version") != 2 or not str(request.get("project") or "").strip():
        raise RequestError("version must be 2 and the project not blank")
    signal, (start, stop) = request.get("signal") or {}, _range(request)
    if signal.get("kind") == "logs_count":
        _known(signal, {"kind", "filter"}, "signal")
        if start is None or stop is None:
            raise RequestError("a count needs start and end")
        some = logs.select(store.logs, request["project"], environment=request.get("environment"))
        return Response(_rows(logs.count(some, start, stop, signal.get("filter"))), watermark=store.watermark(store.logs, request["project"]))
    _known(signal, {"kind", "expression"}, "signal")
    step = request.get("step_seconds", 30)
    if not isinstance(step, int) or not 1 <= step <= 3600:
        raise RequestError("step_seconds is 1 to 3600")
    stop = now if stop is None else stop
    if stop is None:
        raise RequestError("an end is needed")
    try:
        tree = promql.parse(signal.get("expression", ""))
        grid = promql.Grid(stop if start is None else start, step * NANO, 1 if start is None else (stop - start) // (step * NANO) + 1)
        if promql.is_scalar(tree):
            if start is not None:
                raise RequestError("a scalar has no range")
            return Response([{"type": "scalar", "value": promql.scalar(tree)}])
        points = store.points.where(F.col("project") == request["project"]).where(F.col("name").isin(*{s.name for s, _ in promql.selectors(tree)}))
        if request.get("environment") is not None:
            points = points.where(F.col("environment") == request["environment"])
        out = promql.compile_vector(tree, points, grid, store.temporality)
    except promql.PromError as e:
        raise RequestError(str(e)) from e
    series = out.groupBy("key").agg(F.any_value("labels").alias("labels"), F.sort_array(F.collect_list(F.struct("k", "value"))).alias("values")).orderBy("key").limit(MAX_SERIES + 1)
    rows = _rows(series)
    if len(rows) > MAX_SERIES or sum(len(r["values"]) for r in rows) > promql.MAX_EVALUATIONS:
        raise RequestError("the answer has too many series or values")
    kind = "vector" if start is None else "matrix"
    data = [{"type": kind, "labels": r["labels"], "values": [[grid.start + v["k"] * grid.step, v["value"]] for v in r["values"]]} for r in rows]
    return Response(data, watermark=store.watermark(store.points, request["project"]))


_MINI = re.compile(r"\s*(?:(sum|avg|min|max|count|rate)\s*\(\s*)?([A-Za-z_:][A-Za-z0-9_:.]*)\s*(?:\{([^{}]*)\})?\s*(\))?\s*")
_PAIR = re.compile(r'\s*([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*"([^"\\]*)"\s*')


def parse_mini(text: str) -> tuple[str | None, str, dict[str, str]]:
    """function, name and equality matchers of the small dialect; no escapes."""
    m = _MINI.fullmatch(text)
    if not m or bool(m[1]) != bool(m[4]):
        raise RequestError("not a selector or one of six functions of it")
    labels: dict[str, str] = {}
    for part in (m[3] or "").split(",") if (m[3] or "").strip() else []:
        pair = _PAIR.fullmatch(part)
        if not pair or pair[1] in labels:
            raise RequestError("a matcher is label=\"value\", each label once")
        labels[pair[1]] = pair[2]
    return m[1], m[2], labels


def prom_range(store: Store, project: str, text: str, start: int, stop: int, step: int) -> DataFrame:
    """k, labels, value of a small-dialect query at each step; the look-back's lower edge is open."""
    if step <= 0 or stop < start or (stop - start) // step + 1 > promql.MAX_STEPS:
        raise RequestError("1 to 11000 steps")
    function, name, matchers = parse_mini(text)
    count = (stop - start) // step + 1
    points = store.points.where((F.col("project") == project) & (F.col("name") == name) & (F.col("t") <= stop))
    for k, v in matchers.items():
        points = points.where(F.try_element_at("labels", F.lit(k)) == v)
    points = points.withColumn("key", identity(F.col("labels")))
    if function == "rate":
        out = steps.simple_rate(points, ["key"], start, step, count)
    else:
        out = steps.instant(points, ["key"], start, step, count, closed=False)
    if function in (None, "rate"):
        # Labels keep dots; the name goes with a rate as it does with a selector.
        return out.select("k", F.map_concat(F.create_map(F.lit("__name__"), F.lit(name)), promql._labels_of(F.col("key"))).alias("labels"), "value", plain_number(F.col("value")).alias("text"))
    v = F.col("value")
    agg = {"sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count("*").cast("double")}[function]
    return out.groupBy("k").agg(agg.alias("value")).select("k", F.create_map().cast("map<string,string>").alias("labels"), "value", plain_number(F.col("value")).alias("text"))


class Jobs:
    """Queries in the background, their states in a folder of JSON files; those that a restart finds unfinished have failed."""

    def __init__(self, folder: str, workers: int = 4):
        self.folder, self.pool, self.slots = Path(folder), ThreadPoolExecutor(workers), threading.BoundedSemaphore(MAX_RUNNING)
        self.folder.mkdir(parents=True, exist_ok=True)
        for path in self.folder.glob("*.json"):
            job = json.loads(path.read_text())
            if job["state"] in ("queued", "running"):
                self._save(job | {"state": "failed", "error": "the service was restarted"})

    def _save(self, job: dict) -> dict:
        path = self.folder / f"{job['id']}.json"
        path.with_suffix(".tmp").write_text(json.dumps(job, default=str))
        path.with_suffix(".tmp").replace(path)
        return job

    def get(self, job_id: str) -> dict | None:
        if not re.fullmatch("[0-9a-f]{32}", job_id):
            return None
        path = self.folder / f"{job_id}.json"
        return json.loads(path.read_text()) if path.exists() else None

    def submit(self, work: Callable[[], Response]) -> dict:
        if not self.slots.acquire(blocking=False):
            raise RequestError("too many queries are running")
        job = self._save({"id": uuid.uuid4().hex, "state": "queued"})

        def go() -> None:
            try:
                self._save(job | {"state": "running"})
                self._save(job | {"state": "done", "response": asdict(work())})
            except Exception as e:  # the job's owner reads the reason
                self._save(job | {"state": "failed", "error": str(e)[:2000]})
            finally:
                self.slots.release()

        self.pool.submit(go)
        return job


def answer(store: Store, request: dict, jobs: Jobs) -> Response | dict:
    """Run now, or as a job: mode async, or auto with a limit over 500."""
    validate(request)
    mode = request.get("mode", "auto")
    if mode == "async" or (mode == "auto" and request.get("limit", 100) > ASYNC_OVER):
        return jobs.submit(lambda: run(store, request))
    return run(store, request)


def tail(store: Store, project: str, after: int, *, tree: dict | None = None, limit: int = 100, wait: float = 30.0, poll: float = 0.05) -> list[dict]:
    """The first non-empty page of matching logs after a cursor, or none once `wait` seconds (30 at most) are over.

    Each look plans the scan anew, so a table that grows is seen to grow.
    """
    import time

    end = time.monotonic() + min(max(wait, 0.0), 30.0)
    keep = F.lit(True) if tree is None else filters.compile_filter(tree, logs.document())
    while True:
        found = _rows(logs.select(store.logs, project, after=after).where(keep).orderBy("cursor").limit(limit))
        if found or time.monotonic() >= end:
            return found
        time.sleep(poll)


def check_saved_query(project: str, value: dict) -> None:
    """A saved query is a version-2 request of its own project whose expression can be read."""
    if value.get("version") != 2 or value.get("project") != project:
        raise RequestError("a saved query is of version 2 and of its own project")
    signal = value.get("signal") or {}
    if signal.get("kind") == "metrics":
        try:
            promql.parse(signal.get("expression", ""))
        except promql.PromError as e:
            raise RequestError(str(e)) from e
    elif signal.get("kind") != "logs_count":
        raise RequestError("unknown signal")


def observations(store: Store, project: str, source: dict, now: int) -> dict[str, tuple[dict, object]]:
    """What a rule sees at `now`: by series text, its labels and an observation; any failure is one `unknown`."""
    from heliograph.operators.alerts import COMPARE, Seen

    try:
        if source["kind"] == "logs_count":
            start = now - source["window_seconds"] * NANO
            n = logs.count(logs.select(store.logs, project), start, now, source.get("filter")).first()["n"]
            return {"": ({}, Seen("condition", COMPARE[source["comparison"]](float(n), source["threshold"])))}
        if source["kind"] != "metrics":
            raise RequestError("unknown source")
        request = {"version": 2, "project": project, "signal": {"kind": "metrics", "expression": source["expression"]}}
        out: dict[str, tuple[dict, object]] = {}
        for row in run_v2(store, request, now=now).data:
            value = row["value"] if row["type"] == "scalar" else row["values"][0][1]
            labels = row.get("labels") or {}
            finite = value is not None and value == value and abs(value) != float("inf")
            seen = Seen("condition", COMPARE[source["comparison"]](value, source["threshold"])) if finite else Seen("unknown", reason="value is not finite")
            out[json.dumps(labels, sort_keys=True)] = (labels, seen)
        return out
    except Exception as e:  # an alert must see that it does not know
        return {"": ({}, Seen("unknown", reason=str(e)[:500]))}
