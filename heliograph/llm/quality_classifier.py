"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import id_and_text, shared, words_of, worker_cache

TERMS = 8192
RANK = 64
#: Labelled rows that the classifier is fitted on at most; more are sampled by a hash of their id.
MAX_LABELLED = 4096
NEIGHBOURS = 25
BLOCK = 128
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256)))


class _Terms(dict):
    """Term numbers of a word: itself, its ending, and its shape with runs cut short."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        import xxhash

        shape, last = bytearray(), -1
        for c in word.translate(_SHAPE)[:64]:
            if c != last:
                shape.append(c)
            last = c
        number = lambda x: xxhash.xxh3_64_intdigest(x) % TERMS
        got = self[word] = (number(word.lower()), number(b"e:" + word[-3:]), number(b"s:" + bytes(shape)))
        return got


def term_counts(text: str | None) -> np.ndarray:
    """Dense counts of a whole text's terms, and terms for its size, repetition and line ends."""
    import xxhash

    cache = worker_cache()
    known = cache.setdefault("quality_terms", _Terms())
    if len(known) > 200_000:
        known.clear()
    words = words_of(text)
    out = np.bincount(np.fromiter((t for w in words for t in known[w]), np.int64, 3 * len(words)), minlength=TERMS).astype(np.float32)
    n = len(words)
    lines = [x for x in (text or "").split("\n") if x]
    facts = [f"size:{n.bit_length()}", f"varied:{10 * len(set(words)) // max(1, n)}", f"stutter:{10 * sum(a == b for a, b in zip(words, words[1:])) // max(1, n)}", f"lines:{10 * len(set(lines)) // max(1, len(lines))}"]
    for fact in facts:
        out[xxhash.xxh3_64_intdigest(fact) % TERMS] += 8
    return out


class Space:
    """Term weights, latent directions and the labelled vectors: bounded by MAX_LABELLED, TERMS and RANK."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        n = len(counts)
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = self._weigh(counts)
        rng = np.random.default_rng(5)
        # Randomised decomposition with two power steps.
        q = x @ rng.standard_normal((TERMS, min(RANK + 16, max(1, n)))).astype(np.float32) if n else np.zeros((0, 1), np.float32)
        for _ in range(2):
            q, _ = np.linalg.qr(q)
            q = x @ (x.T @ q)
        q, _ = np.linalg.qr(q)
        _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
        self.directions = np.ascontiguousarray(v[:RANK].T.astype(np.float32))
        self.vectors = self._unit(x @ self.directions)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        return x

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        """Weighted rows of length 1, in place: the labelled rows' matrix is there once."""
        np.log1p(counts, out=counts)
        counts *= self.idf
        return self._unit(counts)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; exact products with all of them."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self._unit(self._weigh(counts) @ self.directions) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(np.float64) ** 4
        return np.clip((weight * self.labels[at]).sum(1) / weight.sum(1), 0.0, 1.0)


def split_rows(df: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == held)


def fit(docs: DataFrame, labels: DataFrame, *, parts: int = 5, held: int = 0) -> Space:
    """Fit on labelled rows that are not held out: at most MAX_LABELLED, those of smallest id hash.

    Rows without a label or id are not used; an id labelled twice counts once, with the larger label.
    """
    usable = split_rows(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")), parts, held)
    usable = usable.where("NOT held_out AND doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(t) for t in batch.column(1).to_pylist()]
            found = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tolist() for f in found], pa.list_(pa.int32())), pa.array([c[f].tolist() for c, f in zip(counts, found)], pa.list_(pa.float32()))], ["doc_id", "label", "at", "n"])

    # At most MAX_LABELLED rows of two numbers are broadcast.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(terms, "doc_id long, label int, at array<int>, n array<float>")
    counts, labelled = np.zeros((MAX_LABELLED, TERMS), np.float32), np.zeros(MAX_LABELLED, np.int64)
    seen: dict[int, int] = {}
    for r in rows.toLocalIterator():
        if r["doc_id"] not in seen:
            i = seen[r["doc_id"]] = len(seen)
            counts[i, r["at"]] = r["n"]
            labelled[i] = r["label"]
    order = [seen[doc] for doc in sorted(seen)]  # the fit must not depend on the order of arrival
    counts, labelled = counts[: len(order)], labelled[: len(order)]
    # Row swaps in place, cycle by cycle, instead of a second matrix.
    for start in range(len(order)):
        at = start
        while order[at] != start and order[at] >= 0:
            nxt = order[at]
            counts[[at, nxt]] = counts[[nxt, at]]
            labelled[[at, nxt]] = labelled[[nxt, at]]
            order[at], at = -1, nxt
        order[at] = -1
    return Space(counts, labelled)


def score(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone.

    A null text is empty and scored by its size terms.  Repeated rows and null
    ids each give a row (a null id counts as the empty text for the split).
    Without labelled rows every score is 0.5.
    """
    docs = id_and_text(df, id_col, text_col)
    get = shared(docs.sparkSession, fit(docs, labels, parts=parts, held=held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = get()
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                counts = np.stack([term_counts(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(space.scores(counts), pa.float64())], ["doc_id", "held_out", "score"])

    out = split_rows(docs, parts, held).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
