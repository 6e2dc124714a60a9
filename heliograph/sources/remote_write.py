"""Remote-write series to metric rows; wire bytes by a small reader, since no protobuf jar comes with Spark."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bits of the not-a-number that marks a stale sample: a fixed value.
STALE_BITS = 0x7FF0000000000002
_META = ("__name__", "project", "environment", "deployment.environment.name")


def points(series: DataFrame, project: str) -> DataFrame:
    """Points of (labels map, timestamp ms, bits long) rows; bits are the value's IEEE bits.

    `_total` names are cumulative, others gauges; service., cloud. and k8s.
    labels are resource attributes.  Rows without a name, or of another project,
    get an error.
    """
    get = lambda k: F.try_element_at("labels", F.lit(k))
    name = get("__name__")
    infra = lambda k: k.startswith("service.") | k.startswith("cloud.") | k.startswith("k8s.")
    error = F.when(F.coalesce(name, F.lit("")) == "", "series has no name").when(get("project").isNotNull() & (get("project") != project), "series is of another project")
    resource = F.map_concat(F.map_filter("labels", lambda k, _: infra(k)), F.create_map(F.lit("telemetry.sdk.name"), F.lit("prometheus")))
    return series.select(
        F.lit(project).alias("project"), F.coalesce(get("environment"), get("deployment.environment.name"), F.lit("default")).alias("environment"), name.alias("name"), resource.alias("resource"),
        F.map_filter("labels", lambda k, _: ~infra(k) & ~k.isin(*_META)).alias("attributes"), (F.col("timestamp") * 1_000_000).alias("t"), F.col("stale"), F.when(F.col("stale"), 0.0).otherwise(F.col("value")).alias("value"),
        F.when(name.endswith("_total"), "cumulative").otherwise("gauge").alias("temporality"), error.alias("error"),
    )


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: varints and fixed numbers as integers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7
            if shift > 63:
                raise ValueError("varint is too long")

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        if at + size > len(raw):
            raise ValueError("message is cut short")
        part, at = raw[at : at + size], at + size
        yield tag >> 3, part if kind == 2 else int.from_bytes(part, "little")


def parse_write(raw: bytes) -> list[tuple[dict[str, str], int, int]]:
    """(labels, timestamp ms, value bits) of each sample of an uncompressed write request."""
    out = []
    for number, series in _fields(raw):
        if number != 1:
            continue
        labels: dict[str, str] = {}
        samples = []
        for n, part in _fields(series):
            if n == 1:
                pair = dict(_fields(part))
                labels[pair.get(1, b"").decode()] = pair.get(2, b"").decode()
            elif n == 2:
                sample = dict(_fields(part))
                time = sample.get(2, 0)
                samples.append((time - (1 << 64) if time >> 63 else time, sample.get(1, 0)))
        out += [(labels, t, bits) for t, bits in samples]
    return out


#: Bytes that a request may have when it is unpacked.
MAX_BODY = 64 << 20


def unpacked(raw: bytes) -> bytes:
    """A snappy block as bytes; its length stands in front as a varint."""
    size = shift = 0
    for at, b in enumerate(raw[:5]):
        size |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    else:
        raise ValueError("snappy block without a length")
    if size > MAX_BODY:
        raise ValueError("request is too large")
    return pa.decompress(raw, decompressed_size=size, codec="snappy", asbytes=True)


def decode(df: DataFrame, column: str = "body", *, snappy: bool = False) -> DataFrame:
    """labels, timestamp, value, stale of the samples in binary request bodies; a broken body is one row with an error.

    With `snappy` the bodies are compressed as clients send them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.map_(pa.string(), pa.string()), pa.int64(), pa.float64(), pa.bool_(), pa.string())
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                try:
                    for labels, t, bits in parse_write(unpacked(raw or b"") if snappy else raw or b""):
                        stale = bits == STALE_BITS
                        rows.append((list(labels.items()), t, 0.0 if stale else struct.unpack("<d", bits.to_bytes(8, "little"))[0], stale, None))
                except (ValueError, IndexError, UnicodeDecodeError, OSError) as e:
                    rows.append((None, None, None, None, f"invalid request: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["labels", "timestamp", "value", "stale", "error"])

    return df.select(column).mapInArrow(run, "labels map<string,string>, timestamp long, value double, stale boolean, error string")
