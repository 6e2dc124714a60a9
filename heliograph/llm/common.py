"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

import heliograph
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package travel to the executors by value, so that a cluster
# needs the third-party libraries only and never a copy of this package.
cloudpickle.register_pickle_by_value(heliograph)

#: Words are runs of anything but ASCII white space; bytes.split() cuts at just these.
WORD_GAP = r"[\x20\x09-\x0D]+"
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8; none for a null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_ASCII_LOWER) if lower else raw).split()


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process does."""
    name = "_heliograph_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].data = {}
    return sys.modules[name].data


def shared(spark: SparkSession, value: object):
    """Broadcast a bounded object by value; the function returned gives it, read once a worker and object.

    Plain broadcasts name classes by module, which the executors need not have.
    """
    raw, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), f"shared-{uuid.uuid4().hex}"

    def get() -> object:
        cache = worker_cache()
        if key not in cache:
            for old in [k for k in cache if isinstance(k, str) and k.startswith("shared-")]:
                del cache[old]
            cache[key] = cloudpickle.loads(raw.value)
        return cache[key]

    return get


def release_memory() -> None:
    """Give freed memory back at a task's end: Spark keeps Python workers, and their memory, for the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing is lost but memory


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a local session names none, as in tests, a temporary one is set; a
    cluster's executors would not share one, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="heliograph-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9_]', '_', name.lower())}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Lower the Arrow batch limits where they are higher: batches of whole texts must fit two Python workers an executor."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def pinned(df: DataFrame, name: str, expression: str, keep: list[str]) -> DataFrame:
    """`keep` and a column that is computed once a row, however often what follows refers to it.

    The optimizer copies a projection's expression into the filters and lambdas
    above it; it can't do so across a generator of one row.
    """
    return df.selectExpr(*keep, f"explode(array({expression})) AS {name}")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, under fixed names; other columns can't clash."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (u, v) long pairs in, (node, label) out, label the smallest node reachable.

    Minimum labels pass along links and then jump to the label's own label, so
    that the number of rounds follows the logarithm of a chain's length.  Every
    round is one written table.  Nodes without a link do not appear.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialize(both.where("u <> v").distinct(), "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        hooked = labels.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "nl").alias("l"))
        target = labels.select(F.col("u").alias("l"), F.col("l").alias("far"))
        new = materialize(hooked.join(target, "l", "left").select("u", "was", F.least("l", "far").alias("l")), "labels")
        moved = not new.where("l <> was").isEmpty()
        labels = new.select("u", "l")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("label"))
