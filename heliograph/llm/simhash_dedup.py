"""Near duplicates by SimHash: fingerprints in vantage-point shards, links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import components, id_and_text, materialize, shared, words_of

SEED = 42
#: Fingerprints that the driver reads to place vantage points: one of SAMPLE_STEP, within these bounds.
SAMPLE, MAX_SAMPLE, SAMPLE_STEP = 20_000, 1 << 18, 64
#: Fingerprints that a shard is meant to hold, and that are compared all with all within it.
LEAF, BUCKET = 4096, 256
#: Rows that are routed at once.
ROUTE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included; 0 without a word.

    A bit is set where more than half of the shingles' XXH64 values have it.
    """
    import xxhash

    words = words_of(text, lower=True)
    if not words:
        return 0
    k = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - k + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp long: one row for each input row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """Vantage-point tree over 32-bit codes.

    A node splits at distance mu from its vantage point.  By the triangle
    bound, codes within `radius` of each other that lie on both sides are at
    most `radius` beyond mu, so the near side also takes what lies up to
    mu + radius: each close pair meets in a leaf.
    """

    def __init__(self, sample: np.ndarray, radius: int, total: int, leaf: int):
        self.radius, self.nodes = radius, []  # (vantage, mu, near, far), or None for a leaf
        per = max(1.0, total / max(1, len(sample)))
        self._grow(sample, per, leaf, np.random.default_rng(7))

    def _grow(self, codes: np.ndarray, per: float, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(codes) * per <= leaf or len(codes) < 8:
            return me
        best, seen = None, codes[:: max(1, len(codes) // 1024)]
        for vantage in [*rng.choice(codes, 2), np.uint32(rng.integers(1 << 32))]:
            far = np.bitwise_count(seen ^ vantage).astype(np.int64)
            middle = int(np.median(far))
            for mu in (middle, middle - 1):
                near, rest = int((far <= mu + self.radius).sum()), int((far > mu).sum())
                cost = near * near + rest * rest
                if max(near, rest) < 0.9 * len(seen) and (best is None or cost < best[0]):
                    best = (cost, vantage, mu)
        if best is None:
            return me
        _, vantage, mu = best
        far = np.bitwise_count(codes ^ vantage)
        near = self._grow(codes[far <= mu + self.radius], per, leaf, rng)
        rest = self._grow(codes[far > mu], per, leaf, rng)
        self.nodes[me] = (np.uint32(vantage), mu, near, rest)
        return me

    def leaves(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf number and indices of the codes that belong there, their overlaps included."""
        stack = [(0, np.arange(len(codes)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if self.nodes[node] is None:
                yield node, at
                continue
            vantage, mu, near, rest = self.nodes[node]
            far = np.bitwise_count(codes[at] ^ vantage)
            stack += [(near, at[far <= mu + self.radius]), (rest, at[far > mu])]


def _stars(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the components among these few fingerprints, as stars to each one's first; block by block."""
    n = len(fps)
    labels, block = np.arange(n), max(1, (1 << 19) // max(1, n))
    while True:
        new = labels.copy()
        for begin in range(0, n, block):
            close = np.bitwise_count(fps[begin : begin + block, None] ^ fps[None, :]) <= most
            new[begin : begin + block] = np.minimum(new[begin : begin + block], np.where(close, labels[None, :], n).min(1))
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    linked = np.flatnonzero(labels != np.arange(n))
    return labels[linked], linked


def _split(fps: np.ndarray, views: tuple[tuple[np.uint64, int], ...], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """The two overlapping sides of the best split by a vantage point in one of the views; None if none saves comparisons."""
    n, best = len(fps), None
    seen = fps if n <= 2048 else fps[rng.integers(0, n, 2048)]
    for mask, radius in views:
        for vantage in rng.choice(fps, 2):
            far = np.bitwise_count((seen ^ vantage) & mask).astype(np.int64)
            mu = int(np.median(far))
            for at in (mu, mu - 1, mu - radius):
                near, rest = int((far <= at + radius).sum()), int((far > at).sum())
                cost = near * near + rest * rest
                if cost < 0.85 * len(seen) ** 2 and (best is None or cost < best[0]):
                    best = (cost, mask, radius, vantage, at)
    if best is None:
        return None
    _, mask, radius, vantage, at = best
    far = np.bitwise_count((fps ^ vantage) & mask)
    return np.flatnonzero(far <= at + radius), np.flatnonzero(far > at)


def buckets(fps: np.ndarray, most: int, half: int, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """Index sets of a shard that hold every pair within `most` bits that the shard's half proposes.

    Second-level vantage points: a split may use the shard's own half, where such
    a pair is within most // 2 bits, or the other half, where it is within
    `most`.  A set whose overlaps would eat what a split saves is compared whole,
    in blocks: fingerprints within a few bits altogether, or with one half alike.
    """
    low, high = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
    views = ((high if half else low, most // 2), (low if half else high, most))
    rng, stack = np.random.default_rng(9), [np.arange(len(fps))]
    while stack:
        at = stack.pop()
        sides = _split(fps[at], views, rng) if len(at) > bucket else None
        if sides is None:
            yield at
        else:
            stack += [at[side] for side in sides]


def _local_links(fps: np.ndarray, ids: np.ndarray, most: int, half: int = 0, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard's components, as a star to each component's smallest id: never all pairs."""
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order], ids[order]
    found = [(at[i], at[j]) for at in map(np.sort, buckets(fps, most, half, bucket)) for i, j in [_stars(fps[at], most)]]
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    labels = np.arange(len(fps))
    while True:
        new = labels.copy()
        np.minimum.at(new, j, labels[i])
        np.minimum.at(new, i, labels[j])
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    linked = labels != np.arange(len(fps))
    return ids[labels[linked]], ids[linked]


def sample_size(total: int) -> int:
    return min(MAX_SAMPLE, max(SAMPLE, total // SAMPLE_STEP))


def link_table(nodes: DataFrame, *, most: int = 3, leaf: int = LEAF, sample: int | None = None) -> DataFrame:
    """(u, v) links that give the components of (fp, node) rows with distinct fingerprints.

    Fingerprints at `most` differing bits differ by at most half as many (rounded
    down) in one 32-bit half, so two trees, one for each half, find every pair.
    A shard is split further by the task that has it, so comparisons follow the
    shard's size and not its square.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    sample = sample or sample_size(total)
    share = min(1.0, 1.2 * sample / max(1, total))
    seen = nodes.select("fp").sample(share, 11).limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    halves = [(seen & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seen >> np.uint64(32)).astype(np.uint32)]
    trees = shared(spark, [Tree(np.sort(h), most // 2, total, leaf) for h in halves])

    def routed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        own, ids = table.column(0).chunk(0), table.column(1).chunk(0)
        fps = own.to_numpy().view(np.uint64)
        for which, tree in enumerate(trees()):
            codes = ((fps >> np.uint64(32)) if which else (fps & np.uint64(0xFFFFFFFF))).astype(np.uint32)
            for shards, at in _joined(tree.leaves(codes)):
                yield pa.RecordBatch.from_arrays([pa.array(2 * shards + which), own.take(pa.array(at)), ids.take(pa.array(at))], ["shard", "fp", "node"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= ROUTE:
                yield from routed(held)
                held, rows = [], 0
        if held:
            yield from routed(held)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        u, v = _local_links(table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy(), most, key[0].as_py() % 2)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return nodes.select("fp", "node").mapInArrow(route, "shard long, fp long, node long").groupBy("shard").applyInArrow(link, "u long, v long")


def _joined(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves put together to batches of about ROUTE rows."""
    shards, rows, held = [], [], 0
    for shard, at in parts:
        shards.append(np.full(len(at), shard, np.int64))
        rows.append(at)
        held += len(at)
        if held >= ROUTE:
            yield np.concatenate(shards), np.concatenate(rows)
            shards, rows, held = [], [], 0
    if rows:
        yield np.concatenate(shards), np.concatenate(rows)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, leaf: int = LEAF) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) of every row.

    Equal fingerprints meet as one node first, so a group of copies of any size
    costs a row.  Rows with a null id keep their fingerprint and have component
    null; empty texts share fingerprint 0 and link like any other; an empty
    table gives none.
    """
    prints = materialize(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = materialize(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # An id with several texts stands for all of them: its fingerprints are linked as well.
    rows = prints.where("doc_id IS NOT NULL").select("doc_id", "fp").distinct()
    nodes_of_many = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    tied = rows.join(nodes_of_many, "doc_id").join(nodes, "fp").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    groups = components(link_table(nodes, most=most, leaf=leaf).union(tied))
    named = nodes.join(groups, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Dropped ids that are broadcast at most (8 bytes each); more take a shuffle join.
BROADCAST_IDS = 2_000_000


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """The row of smallest id of each group of near duplicates, with all its columns.

    `groups` (doc_id, component_id of every row) may come from another operator.

    Rows that share an id count as near duplicates of each other: the one of
    smallest text stays.  Rows with a null id are no one's duplicate and stay.
    """
    if groups is None:
        groups = near_duplicates(df, id_col=id_col, text_col=text_col, shingle=shingle, most=most)
    ids = materialize(groups.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "groups")

    def ids_where(condition: str) -> DataFrame:
        chosen = ids.where(condition).select(F.col("doc_id").alias("_dropped"))
        return F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen

    key = df[id_col].cast("long") == F.col("_dropped")
    kept = df.join(ids_where("doc_id <> component_id"), key, "left_anti")
    repeated = ids_where("n > 1 AND doc_id = component_id")
    if repeated.isEmpty():
        return kept
    order = Window.partitionBy(F.col(id_col).cast("long")).orderBy(F.col(text_col).asc_nulls_first())
    one = kept.join(repeated, kept[id_col].cast("long") == F.col("_dropped"), "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return kept.join(repeated, kept[id_col].cast("long") == F.col("_dropped"), "left_anti").unionByName(one)
