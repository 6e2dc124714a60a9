"""Substring dedup: winnowed anchors as seeds, extended to every repeated window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import id_and_text, materialize, release_memory, shared, words_of, worker_cache

WINDOW, SEED_WORDS = 13, 5
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
MAX_WORDS_HELD = 500_000


class _Hashes(dict):
    """Hash of each word seen, computed once; emptied by its owner when it grows."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def word_hashes(words: list[bytes]) -> np.ndarray:
    cache = worker_cache()
    known = cache.setdefault("word_hashes", _Hashes())
    if len(known) > MAX_WORDS_HELD:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * _M2
    a = (a ^ (a >> np.uint64(32))) * _M3
    return a ^ (a >> np.uint64(29))


def _roll(h: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * by + h[j : j + n]
    return _mix(out)


def anchors(h: np.ndarray, window: int = WINDOW, seed_words: int = SEED_WORDS):
    """The anchor of each window of `window` words: its leftmost seed of smallest hash.

    Equal windows have equal anchors at equal offsets.  Returns the seed's
    hash, the first window and the number of windows for each run of windows
    with one anchor, and a check hash of every window.
    """
    n = len(h) - window + 1
    seeds = _roll(h, seed_words, _M1)
    wide = window - seed_words + 1
    at = np.lib.stride_tricks.sliding_window_view(seeds, wide).argmin(1) + np.arange(n)
    begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    counts = np.diff(np.append(begins, n))
    return seeds[at[begins]], at[begins], begins, counts, _roll(h, window, _M3)


#: Anchors that a task holds for its map-side combine: some 15 MB.
COMBINE = 200_000
#: `route` is the seed of rows that go on, and spreads those that are decided.
_ROWS = "route long, doc_id long, doc_key long, begin int, ahead int, mask int, checks binary"


class _Block:
    """Anchors of several documents, combined before they travel.

    Where runs of windows are the same in several documents of the block, those
    in any but the smallest are decided at once: the smallest has them all.
    Only its run goes on to meet other blocks, so a passage that a third of all
    documents share costs a row for each block, not for each document.
    """

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, doc: int, key: int, h: np.ndarray, window: int, seed_words: int) -> None:
        seed, at, begin, count, check = anchors(h, window, seed_words)
        n = len(seed)
        # A run's first and last window hold all its words.
        same = _mix(_mix(seed * _M1 + check[begin]) * _M2 + check[begin + count - 1] + count.astype(np.uint64))
        self.parts.append((seed, np.full(n, doc, np.int64), np.full(n, key, np.int64), begin, at - begin, count, same, check))
        self.held += n

    def rows(self) -> pa.RecordBatch:
        seed, doc, key, begin, ahead, count, same, check = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((doc, same))
        head = np.concatenate(([True], same[order][1:] != same[order][:-1]))
        least = np.empty(len(doc), np.int64)
        least[order] = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))]
        decided = doc > least
        mask = np.where(decided, (1 << count) - 1, 0)
        route = np.where(decided, _mix(doc.view(np.uint64)), seed).view(np.int64)
        ends = np.concatenate(([0], np.cumsum(np.where(decided, 0, 8 * count)))).astype(np.int32)
        data = check[np.repeat(~decided, count)].astype("<u8").tobytes()
        blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        longs, ints = (route, doc, key), (begin, ahead, mask)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), *(pa.array(x.astype(np.int32)) for x in ints), blob], ["route", "doc_id", "doc_key", "begin", "ahead", "mask", "checks"])


def _text_key(text: str, keyed: bool) -> int:
    """Tells the texts of one id apart, where an id has several."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text) & 0x7FFFFFFF if keyed else 0


def _seed_rows(window: int, seed_words: int, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if doc is None or len(words) < window:
                    continue
                block.add(doc, _text_key(text, keyed), word_hashes(words), window, seed_words)
                if block.held > COMBINE:
                    yield block.rows()
        if block.held:
            yield block.rows()
        release_memory()

    return run


def _extend():
    """Rows sorted by (route, doc_id): the first document that shows a window is the smallest that has it.

    State is the distinct windows of the seed that a batch breaks off in; rows
    pass through, however many documents share a seed.
    """
    names = ["doc_id", "doc_key", "begin", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_doc = None, {}  # of the seed at the end of the batch before
        for whole in batches:
            decided = whole.column(5).to_numpy() != 0
            if decided.any():
                at = pa.array(np.flatnonzero(decided))
                yield pa.RecordBatch.from_arrays([whole.column(i).take(at) for i in (1, 2, 3, 5)], names)
            batch = whole.take(pa.array(np.flatnonzero(~decided)))
            if not batch.num_rows:
                continue
            seed, doc, ahead = (batch.column(i).to_numpy() for i in (0, 1, 4))
            blob = batch.column(6)
            ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
            check = np.frombuffer(blob.buffers()[2], "<u8")[ends[0] // 8 : ends[-1] // 8]
            size = np.diff(ends) // 8
            row = np.repeat(np.arange(len(seed)), size)
            place = np.arange(len(check)) - np.repeat(np.cumsum(size) - size, size)
            # A window's place in front of its seed is part of what makes two windows equal.
            what = _mix(check + _M2 * (ahead[row] - place).astype(np.uint64))
            key = _mix(seed[row].view(np.uint64) * _M1 + what)
            _, head, back = np.unique(key, return_index=True, return_inverse=True)
            first = doc[row[head]]
            if last is not None and seed[0] == last and first_doc:
                for i in np.unique(back[seed[row] == last]):
                    first[i] = min(first[i], first_doc.get(int(key[head[i]]), first[i]))
            gone = doc[row] > first[back]
            tail = seed[-1]
            if tail != last:
                first_doc = {}
            last = tail
            for i in np.unique(back[seed[row] == tail]):
                first_doc.setdefault(int(key[head[i]]), int(first[i]))
            mask = np.bincount(row, weights=gone * (1 << place), minlength=len(seed)).astype(np.int32)
            hit = np.flatnonzero(mask)
            if len(hit):
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (1, 2, 3)), pa.array(mask[hit], pa.int32())], names)

    return run


def repeated_windows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS, keyed: bool = True) -> DataFrame:
    """doc_id, doc_key, begin, mask: windows that also start in a document with a smaller id.

    Bit i of the mask stands for the window at word begin + i.  One row for each
    seed whose windows were extended to a match.  One shuffle, by seed.  Without
    `keyed` no id may have two rows, and doc_key is 0.
    """
    rows = id_and_text(df, id_col, text_col).mapInArrow(_seed_rows(window, seed_words, keyed), _ROWS)
    return rows.repartition("route").sortWithinPartitions("route", "doc_id").mapInArrow(_extend(), "doc_id long, doc_key long, begin int, mask int")


#: Bits of the filter of ids with hits: 16 for each id, between these bounds.  Beyond the upper one, 16 MB, more texts travel.
FILTER_BITS, MAX_FILTER_BITS = 1 << 16, 1 << 27


def _hit_filter(hits: DataFrame) -> tuple[np.ndarray, Column]:
    """A bit for every id that has hits, and the column that gives an id's bit; few other ids share it."""
    ids = hits.select("doc_id").distinct()
    size = min(MAX_FILTER_BITS, max(FILTER_BITS, 1 << (16 * ids.count() - 1).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    words = ids.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64), bit


def _has_hits(filter_bits: np.ndarray, bits: pa.Array) -> np.ndarray:
    at = bits.to_numpy().astype(np.uint64)
    return (filter_bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


_OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<from: long, to: long>>"
_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _whole(get):
    """Rows of ids without hits keep all words; they are done where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~_has_hits(get(), batch.column(2))))
            words = [words_of(t) for t in rest.column(1).to_pylist()]
            kept = pa.array([b" ".join(w).decode("utf-8") for w in words], pa.string())
            none = pa.array([[]] * len(words), _SPANS)
            yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(map(len, words), pa.int64()), pa.array([0] * len(words), pa.int64()), kept, none], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return run


def _packed(get, keyed: bool):
    """Rows of the other ids travel to their hits, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=4)
        for batch in batches:
            some = batch.filter(pa.array(_has_hits(get(), batch.column(2))))
            texts = [t or "" for t in some.column(1).to_pylist()]
            keys = [_text_key(t, keyed) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys, pa.int64()), pa.array((squeeze.compress(t.encode()) for t in texts), pa.binary())], ["doc_id", "doc_key", "packed"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = loose.decompress(packed).split()
                n = len(words)
                spans: list[tuple[int, int]] = []
                if hits:
                    start, mask = np.array(hits) >> 32, np.array(hits) & 0xFFFFFFFF
                    marks = np.zeros(n + 1, np.int64)
                    for bit in range(window):
                        at = start[(mask >> bit) & 1 == 1] + bit
                        np.add.at(marks, at, 1)
                        np.add.at(marks, at + window, -1)
                    gone = np.cumsum(marks[:n]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((n, n - len(words), b" ".join(words).decode("utf-8"), spans))
            spans = pa.array([[{"from": a, "to": b} for a, b in x[3]] for x in out], _SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), spans],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    return run


def substring_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed (maximal word spans, end exclusive) of every row.

    A word goes when a window of `window` words that covers it also starts in a
    row with a smaller id; repeats within one id stay.  A null text has no
    words; a row with a null id neither loses words nor makes others lose them.
    Repeated rows are judged alike.  Texts of ids that may have hits travel
    compressed, once; the others don't.
    """
    base = id_and_text(df, id_col, text_col)
    repeated = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    keyed = not repeated.isEmpty()
    found = materialize(repeated_windows(base, window=window, seed_words=seed_words, keyed=keyed), "hits")
    filter_bits, bit = _hit_filter(found)
    get, placed = shared(base.sparkSession, filter_bits), base.select("doc_id", "text", bit.alias("bit"))
    whole = placed.mapInArrow(_whole(get), _OUT)
    # A hit is its first window and its mask in one value: nested columns are four times as large.
    hits = found.groupBy("doc_id", "doc_key").agg(F.collect_list(F.expr("shiftleft(cast(begin AS long), 32) | mask")).alias("hits"))
    texts = placed.mapInArrow(_packed(get, keyed), "doc_id long, doc_key long, packed binary")
    both = texts.join(hits.hint("merge"), ["doc_id", "doc_key"], "left").select("doc_id", "packed", "hits")
    return whole.unionByName(both.mapInArrow(_cut(window), _OUT))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The same by comparing all windows, for tests."""
    first: dict[tuple, int] = {}
    cut = [(doc, words_of(text)) for doc, text in rows]
    for doc, words in cut:
        if doc is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in cut:
        gone = set()
        if doc is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
