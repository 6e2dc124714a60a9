"""Benchmark decontamination in DataFrame operations only.

Item-sized windows of a document get SimHash fingerprints, multi-index Hamming
blocks bring together every window and item within the radius, and the exact
weighted similarity of their five-word shingles decides.  Windows that hold too
few of an item's shingles to reach the similarity get no fingerprint.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import id_and_text, materialize, pinned

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_DIFFS = 8, 8, 2
#: Eight blocks with three differences in one of them need 24 in all: 23 are always found.
RADIUS = BLOCKS * (BLOCK_DIFFS + 1) - 1
#: Shingles and items of the benchmark that one pass over the documents looks for: its broadcasts hold
#: 40 bytes a shingle, and 300 probes of 48 bytes an item.  A larger benchmark takes several passes.
PASS_SHINGLES, PASS_ITEMS = 500_000, 2_000
#: Contaminated documents whose keys are broadcast at most (16 bytes each).
BROADCAST_KEYS = 2_000_000

_WORDS = r"array_remove(split(lower(text), '[^\\p{L}\\p{N}]+'), '')"
_SHINGLES = f"""CASE WHEN size(words) >= {SHINGLE} THEN transform(sequence(0, size(words) - {SHINGLE}),
    i -> xxhash64({', '.join(f'words[i + {j}]' for j in range(SHINGLE))})) ELSE array() END"""


def _shingled(df: DataFrame, *extra: str) -> DataFrame:
    words = pinned(df, "words", f"coalesce({_WORDS}, array())", [*extra])
    return pinned(words, "grams", _SHINGLES, [*extra])


def _fingerprint(grams: str) -> str:
    """SimHash of an array of hashes: a bit is set where more than half of them have it."""
    one = f"size(filter({grams}, h -> (shiftrightunsigned(h, b) & 1L) = 1L))"
    return f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE WHEN 2 * {one} > size({grams}) THEN shiftleft(1L, b) ELSE 0L END)"


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The table marked for broadcast if its counted size is within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = _shingled(items.where("item_id IS NOT NULL"), "item_id").where("size(grams) > 0").distinct()
    return materialize(items.select("item_id", F.size("grams").alias("size"), F.col("grams").alias("item_grams"), F.expr(_fingerprint("grams")).alias("item_fp")), "items")


def _probes(items: DataFrame) -> DataFrame:
    """Every value within BLOCK_DIFFS bits of each block of an item's fingerprint."""
    near = [v for v in range(1 << BLOCK_BITS) if v.bit_count() <= BLOCK_DIFFS]
    probes = items.select("item_id", "size", "item_fp", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("block"))
    probes = probes.select("item_id", "size", "item_fp", "block", F.explode(F.array(*map(F.lit, near))).alias("diff"))
    return probes.selectExpr("item_id AS found_id", "size", "item_fp", "block", f"((shiftrightunsigned(item_fp, {BLOCK_BITS} * block) & {(1 << BLOCK_BITS) - 1}L) ^ diff) AS part")


def _windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """doc_id, doc_key, size, start, seen: the windows that can reach the similarity with an item of their size.

    A window that does not start with a shingle of the item loses nothing when
    it moves on by one, up to the document's last window.  So the last of the
    best windows starts at a shared shingle, or is the last of all; each such
    start is tried.  What the window and the item have in common is at most the
    number of the window's shingles that occur in the item, and must be
    s / (1 + s) of both sizes together.
    """
    at = docs.select("doc_id", "doc_key", "grams", F.posexplode("grams").alias("pos", "gram"))
    seeds = items.select("item_id", "size", F.explode(F.array_distinct("item_grams")).alias("gram"))
    hits = at.join(F.broadcast(seeds), "gram").selectExpr("doc_id", "doc_key", "item_id", "size", "greatest(0, least(pos, size(grams) - size)) AS start", "grams")
    seen = pinned(hits, "seen", "slice(grams, start + 1, size)", ["doc_id", "doc_key", "item_id", "size", "start"])
    held = seen.join(F.broadcast(items.select("item_id", "item_grams")), "item_id")
    least = similarity / (1 + similarity) * (1 - 1e-12)
    able = held.where(f"size(filter(seen, g -> array_contains(item_grams, g))) >= {least!r}D * (size(seen) + size)")
    return able.groupBy("doc_id", "doc_key", "size", "start").agg(F.first("seen").alias("seen"))


def _matches(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    windows = pinned(_windows(docs, items, similarity), "fp", _fingerprint("seen"), ["*"])
    blocks = windows.select("*", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("block"))
    blocks = blocks.selectExpr("*", f"(shiftrightunsigned(fp, {BLOCK_BITS} * block) & {(1 << BLOCK_BITS) - 1}L) AS part")
    # A pair that meets in several blocks is taken in the first of them.
    first = " AND ".join(f"(block <= {b} OR bit_count(shiftrightunsigned(fp ^ item_fp, {BLOCK_BITS * b}) & {(1 << BLOCK_BITS) - 1}L) > {BLOCK_DIFFS})" for b in range(BLOCKS - 1))
    pairs = blocks.join(F.broadcast(_probes(items)), ["size", "block", "part"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}").where(first)
    pairs = pairs.join(F.broadcast(items.select(F.col("item_id").alias("found_id"), "item_grams")), "found_id")
    common = "aggregate(array_distinct(seen), 0, (acc, x) -> acc + least(size(filter(seen, y -> y = x)), size(filter(item_grams, y -> y = x))))"
    scored = pairs.selectExpr("doc_id", "doc_key", "found_id AS item_id", "start", "size(seen) AS n", "bit_count(fp ^ item_fp) AS distance", "size(seen) + size(item_grams) AS both", f"{common} AS common")
    return scored.selectExpr("doc_id", "doc_key", "item_id", "start", "n", "distance", "common / (both - common) AS similarity").where(F.col("similarity") >= similarity)


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, doc_key, item_id, similarity, distance, window_start, window_words of each document and item that match.

    Words are runs of letters and digits of the lower-cased text, so marks stuck
    to words don't hide a passage.  A window holds as many shingles as the item
    (a shorter document: all of it); any window can match, its parts in any order.
    The similarity is the sum of the smaller shingle counts over the sum of the
    larger ones; the best window of a document and item counts, the last of
    equal ones.  Null texts and texts or items under five words match nothing;
    rows with equal id and text count once; null ids stay null.  doc_key is a hash of the text.

    No broadcast grows with the documents, and a benchmark beyond PASS_SHINGLES
    or PASS_ITEMS is looked for part by part, each in a pass over the documents.
    """
    items = _items(benchmark, item_col, item_text_col)
    docs = id_and_text(df, id_col, text_col).selectExpr("doc_id", "text", "xxhash64(text) AS doc_key")
    docs = _shingled(docs, "doc_id", "doc_key")
    size = items.agg(F.count("*").alias("n"), F.sum("size").alias("grams")).first()
    passes = max(1, math.ceil(size["n"] / PASS_ITEMS), math.ceil((size["grams"] or 0) / PASS_SHINGLES))
    parts = [items] if passes == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) for k in range(passes)]
    scored = functools.reduce(DataFrame.unionByName, [_matches(docs, part, similarity) for part in parts])
    best = scored.groupBy("doc_id", "doc_key", "item_id").agg(F.max(F.struct("similarity", "start", "n", "distance")).alias("best"))
    return best.selectExpr(
        "doc_id", "doc_key", "item_id", "best.similarity AS similarity", "best.distance AS distance", "cast(best.start AS long) AS window_start", f"cast(best.n + {SHINGLE - 1} AS long) AS window_words"
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows without a match, all their columns unchanged."""
    found = contaminated(df, benchmark, id_col=id_col, text_col=text_col, similarity=similarity)
    keys = materialize(found.select(F.col("doc_id").alias("_bad_id"), F.col("doc_key").alias("_bad_key")).distinct(), "contaminated")
    match = df[id_col].cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(df[text_col].cast("string")) == F.col("_bad_key"))
    return df.join(_small(keys, BROADCAST_KEYS), match, "left_anti")


#: The same answer without hashes or fingerprints, for DuckDB: every window that holds a shingle of the item.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) - 4 AS n, unnest(range(0, len(w) - 4)) AS pos, w FROM d WHERE len(w) >= 5),
ds AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS gram FROM dg),
bg AS (SELECT item_id, len(w) - 4 AS size, unnest(range(0, len(w) - 4)) AS ahead, w FROM b WHERE len(w) >= 5),
ic AS (SELECT item_id, size, array_to_string(w[ahead + 1:ahead + 5], ' ') AS gram, count(*) AS c FROM bg GROUP BY ALL),
sh AS (SELECT doc_id, item_id, size, n, pos, gram, c, unnest(range(greatest(0, pos - size + 1), least(pos, greatest(0, n - size)) + 1)) AS start FROM ds JOIN ic USING (gram)),
wc AS (SELECT doc_id, item_id, size, n, start, gram, least(count(*), c) AS common FROM sh GROUP BY doc_id, item_id, size, n, start, gram, c),
scored AS (SELECT doc_id, item_id, start, least(n, size) AS n, sum(common) / (least(n, size) + size - sum(common)) AS similarity FROM wc GROUP BY doc_id, item_id, size, n, start),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start DESC) AS k FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, CAST(start AS BIGINT) AS window_start, CAST(n + 4 AS BIGINT) AS window_words FROM best WHERE k = 1
"""
