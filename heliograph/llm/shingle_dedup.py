"""Near duplicates by the similarity of five-word shingles: SimHash fingerprints in vantage-point shards propose pairs,
MinHash bands those that lie beyond the fingerprints' radius; the exact similarity decides on both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import simhash_dedup
from heliograph.llm.common import components, id_and_text, materialize, release_memory, words_of, worker_cache
from heliograph.llm.substring_dedup import _mix, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of fingerprints that the vantage-point shards find: op 6's radius, the largest that trees over 32-bit halves prune at.
MOST_BITS = 3
#: A pair of similarity 0.8 meets in no band with probability (1 - 0.8**4)**26, about one in a million.
BANDS, BAND_ROWS = 26, 4
#: Members of a bucket, or partners of a node, that one group of rows compares.
BLOCK = 500
#: Hashes that a comparison of blocks takes at once, and columns of one matrix product.
PASS, COLUMNS = 2_000_000, 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's word shingles; a shorter text is one shingle, an empty one none."""
    h = word_hashes(words_of(text, lower=True))
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = _mix(out * _MULTIPLIER + h[j : j + len(out)] + np.uint64(1))
    return np.unique(out)


def similar(a: set, b: set, similarity: float = SIMILARITY) -> bool:
    """Whether the common part of two sets is at least `similarity` of both together."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    common = len(a & b)
    return common >= similarity * (small + large - common)


def _key(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes())


def _bands(grams: np.ndarray) -> np.ndarray:
    salts = _mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)
    least = np.array([((grams ^ (s >> np.uint64(7))) * s >> np.uint64(16)).min() for s in salts]).reshape(BANDS, BAND_ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in range(BAND_ROWS):
        out = _mix(out * _MULTIPLIER + least[:, row])
    return out.view(np.int64)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(u, v) pairs of keys whose fingerprints are equal or linked by vantage-point shards, as stars to the smallest."""
    by_print = materialize(nodes.groupBy("fp").agg(F.min("key").alias("node")), "fingerprints")
    equal = nodes.select("key", "fp").join(by_print, "fp").where("key <> node").select(F.col("node").alias("u"), F.col("key").alias("v"))
    return materialize(equal.unionByName(simhash_dedup.link_table(by_print, most=MOST_BITS)), "proposed")


def _sets(bands: bool):
    kinds = [("doc_id", pa.int64()), ("key", pa.int64()), ("bands", pa.list_(pa.int64())) if bands else ("grams", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, prints = [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text)
                keys.append(_key(grams))
                values.append((_bands(grams) if len(grams) else []) if bands else grams.tobytes())
                if bands:
                    prints.append(simhash_dedup.majority(grams))
            columns = [batch.column(0), _longs(keys), pa.array(values, kinds[2][1])]
            yield pa.RecordBatch.from_arrays([*columns, _longs(prints)] if bands else columns, [*(k for k, _ in kinds), *(["fp"] if bands else [])])
        # Later stages take other workers' functions: the words' hashes need not stay.
        worker_cache().pop("word_hashes", None)
        release_memory()

    return run


def _alike(a: bytes, b: bytes, similarity: float) -> bool:
    """`similar` of two sorted sets as they travel."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    if len(a) < similarity * len(b):
        return False
    common = int((b[np.minimum(b.searchsorted(a), len(b) - 1)] == a).sum()) if len(a) else 0
    return common >= similarity * (len(a) + len(b) - common)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [i for i in range(batch.num_rows) if _alike(batch.column(2)[i].as_buffer(), batch.column(3)[i].as_buffer(), similarity)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)], ["u", "v"])
        release_memory()

    return run


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the common parts of every set of `a` with every set of `b` (without it, of `a` itself).

    Sets are sorted distinct hashes.  They are taken in ranges of the hash, so that
    memory follows PASS and not the sets; a range is a product of 0/1 matrices
    over the hashes that two sets or more hold.
    """
    sets = a if b is None else a + b
    out = np.zeros((len(a), len(a if b is None else b)), np.float64)
    passes = 1 + sum(map(len, sets)) // PASS
    edges = np.linspace(0, 2.0**64, passes + 1)[1:-1].astype(np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in sets]
    for k in range(passes):
        parts = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts)]
        _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(parts)), list(map(len, parts)))
        met = times[column] > 1
        row, column = row[met], (np.cumsum(times > 1) - 1)[column[met]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [first, first + COLUMNS])
            ones = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
            ones[row[lo:hi], column[lo:hi] - first] = 1
            out += ones @ ones.T if b is None else ones[: len(a)] @ ones[len(a) :].T
    return out


def _across(similarity: float):
    """Links between the components of two blocks' members (or of one block's): a forest, never all pairs."""

    def link(key: tuple, table: pa.Table) -> pa.Table:
        mine, nodes = table["mine"].to_numpy(), table["node"].to_numpy()
        order = np.argsort(mine, kind="stable")
        nodes, root = nodes[order], table["label"].to_numpy()[order].copy()
        blobs = table["grams"].to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
        across = key[1] != key[2]
        cut = int((mine == key[1].as_py()).sum()) if across else 0
        common = common_counts(sets[cut:], sets[:cut] if across else None)
        size = np.array(list(map(len, sets)), np.float64)
        out = []
        for i in range(cut, len(nodes)):
            others = size[:cut] if across else size[:i]
            near = common[i - cut, : len(others)]
            with_i = np.flatnonzero(near >= similarity * (size[i] + others - near))
            while len(with_i := with_i[root[with_i] != root[i]]):
                j = with_i[0]
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                out.append((nodes[i], nodes[j]))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return link


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs of `similarity` or more, itself included) of every row.

    Rows of equal shingle sets meet as one node first.  Nodes whose SimHash
    fingerprints the vantage-point shards link are compared.  Each node is compared with
    the smallest node of its buckets as well; where a bucket's members are not yet in
    one component, all its members of different components are compared, block by
    block.  Rows with a null id have component null; empty texts are alike.
    """
    base = id_and_text(df, id_col, text_col)
    prints = materialize(base.mapInArrow(_sets(True), "doc_id long, key long, bands array<long>, fp long"), "shingles")
    rows = prints.where("doc_id IS NOT NULL")
    nodes = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "nodes")
    proposed = _by_fingerprint(nodes.where("size(bands) > 0"))
    # An id with several texts has several keys: nodes are named by key until the end.
    members = nodes.select(F.col("key").alias("node"), F.explode("bands").alias("bucket"))
    crowds = members.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(crowds, "bucket"), "members")
    wanted = members.select(F.col("node").alias("key")).unionByName(proposed.selectExpr("explode(array(u, v)) AS key")).distinct()
    ids = nodes.join(wanted, "key", "left_semi").select("key", F.col("node").alias("doc_id"))
    sets = base.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(False), "doc_id long, key long, grams binary")
    sets = materialize(sets.join(ids, ["doc_id", "key"], "left_semi").dropDuplicates(["key"]).select(F.col("key").alias("node"), "grams"), "sets")

    pairs = members.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).unionByName(proposed).distinct()
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(1 << 20)))
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    many = materialize(many, "centers")
    centers = sets.join(many, sets["node"] == many["u"]).select("u", "parts", F.col("grams").alias("grams_u"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    asked = pairs.join(many, "u").select("u", "v", F.expr("cast(salt % parts AS int)").alias("part")).join(sets.select(F.col("node").alias("v"), "grams"), "v")
    links = materialize(asked.join(centers, ["u", "part"]).select("u", "v", "grams_u", "grams").mapInArrow(_verified(similarity), "u long, v long"), "links")

    labels = components(links)
    named = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    split = named.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"), F.count("*").alias("n")).where("a <> b")
    # Buckets of the same members are compared once.
    once = materialize(split.groupBy("same", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "unresolved")
    dealt = named.join(once, "bucket", "left_semi").selectExpr("bucket", "node", "label", f"cast(ceil(n / {BLOCK}) AS int) AS parts")
    dealt = dealt.selectExpr("*", "cast(pmod(xxhash64(node), parts) AS int) AS mine", "explode(sequence(0, parts - 1)) AS other")
    dealt = dealt.selectExpr("bucket", "least(mine, other) AS low", "greatest(mine, other) AS high", "mine", "node", "label").join(sets, "node")
    more = dealt.groupBy("bucket", "low", "high").applyInArrow(_across(similarity), "u long, v long")
    groups = components(links.unionByName(materialize(more, "links")))

    label = nodes.select("key", "node").join(groups.select(F.col("node").alias("key"), "label"), "key", "left").select("key", "node", F.coalesce("label", "key").alias("label"))
    # Keys of one id are one group as well.
    least = label.groupBy("label").agg(F.min("node").alias("least"))
    of_key = materialize(label.join(least, "label").select("key", "least"), "keys")
    seen = rows.select("doc_id", "key").distinct().join(of_key, "key").select("doc_id", "least").distinct()
    by_id = materialize(components(seen.select(F.col("doc_id").alias("u"), F.col("least").alias("v"))), "ids")
    out = prints.select("doc_id").join(by_id, prints["doc_id"] == by_id["node"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
