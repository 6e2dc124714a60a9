import random
import re
from collections import Counter

import duckdb

from heliograph.llm import decontamination as dc


def plain(docs, items, least=0.8):
    """Every window of an item's size against the item."""
    cut = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for doc, text in docs:
        g = grams(cut(text))
        for item, other in items:
            b = grams(cut(other))
            if not set(b) & set(g):  # every window has similarity 0
                continue
            size = min(len(b), len(g))
            for s in range(len(g) - size + 1):
                common = sum((Counter(g[s : s + size]) & Counter(b)).values())
                sim = common / (size + len(b) - common)
                if sim >= least:
                    out[doc, item] = max(out.get((doc, item), 0), sim)
    return out


def made():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60 + 90 * (i % 3))))) for i in range(30)]
    docs = []
    for i in range(160):
        text = rng.choices(words, k=rng.randint(0, 80))
        if i % 2:
            part = items[rng.randrange(30)][1].split()
            for _ in range(rng.randint(0, 3)):
                at, what = rng.randrange(len(part)), rng.random()
                part[at : at + (what < 0.6)] = [rng.choice(words)] if what < 0.3 or what > 0.6 else []
            cut = [part[k : k + 7] for k in range(0, len(part), 7)]
            if what := i % 8 // 2:  # in order, halves swapped, parts shuffled, interleaved with repeats
                if what == 1:
                    part = part[len(part) // 2 :] + part[: len(part) // 2]
                elif what == 2:
                    rng.shuffle(cut)
                    part = sum(cut, [])
                else:
                    part = part[: len(part) // 2] + part[len(part) // 2 - 6 :]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((i, ", ".join(text).upper() if i % 3 else "*** ".join(text)))
    return docs + [(1500, None), (1501, ""), (1502, "a b c d e " * 30)], items + [(90, None), (91, "a b c d e " * 4)]


def test_matches_equal_brute_force(spark, edge_rows):
    docs, items = made()
    docs = docs + [(2000 + i, t) for i, t in edge_rows if i is not None and i != 4]
    d = spark.createDataFrame([(i, t, 7, 8) for i, t in docs], "doc_id long, text string, item_id int, grams int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(d, b).collect()}
    want = plain(docs, items)
    assert len(want) > 15 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r.doc_id for r in dc.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {k[0] for k in want}
    assert dc.decontaminate(d, b).columns == d.columns


def test_sql_gives_the_same(spark):
    documents, benchmark = made()
    d, b = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        con.register(name, df.toPandas())
    want = sorted(con.sql(dc.SQL).fetchall())
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 6), r.window_start, r.window_words) for r in dc.contaminated(d, b).collect())
    assert got == want


def test_reordered_passages_are_found(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(5000)}" for _ in range(80)]
    around = [f"u{rng.randrange(5000)}" for _ in range(300)]
    parts = [item[k : k + 20] for k in range(0, 80, 20)]
    forms = {0: item, 1: item[40:] + item[:40], 2: parts[1] + parts[2] + parts[0] + parts[3], 3: item[:30] + item[50:]}
    docs = [(k, " ".join(around[:150] + f + around[150:])) for k, f in forms.items()]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in dc.contaminated(d, b).collect()}
    want = plain(docs, [(5, " ".join(item))])
    assert set(got) == {0, 1, 2} == {k for k, _ in want} and all(abs(got[k] - want[k, 5]) < 1e-9 for k in got)


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    docs, items = made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r.doc_id, r.item_id, r.similarity, r.window_start)
    want = sorted(map(key, dc.contaminated(d, b).collect()))
    monkeypatch.setattr(dc, "PASS_ITEMS", 9)
    assert sorted(map(key, dc.contaminated(d, b).collect())) == want


def test_few_pairs_at_the_threshold_lie_beyond_the_radius():
    """SimHash distances of multisets at the least similarity that still counts, for several sizes."""
    import numpy as np

    rng, far, pairs = np.random.default_rng(4), 0, 0
    bits = lambda h: 2 * ((h[..., None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(1) > h.shape[1]
    for n in (9, 18, 27, 36, 54, 90):
        common = -(-8 * n // 9)
        a = rng.integers(0, 1 << 63, (3000, n), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (3000, n), dtype=np.uint64)
        b = a.copy()
        b[:, common:] = rng.integers(0, 1 << 63, (3000, n - common), dtype=np.uint64) * np.uint64(2)
        distance = (bits(a) != bits(b)).sum(1)
        far, pairs = far + (distance > dc.RADIUS).sum(), pairs + 3000
    assert far <= pairs / 2000


def test_empty_tables_and_ids(spark, no_docs):
    docs, items = made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contaminated(no_docs, b).collect() == [] and dc.decontaminate(no_docs, b).collect() == []
    assert dc.contaminated(d, b.limit(0)).collect() == [] and dc.decontaminate(d, b.limit(0)).count() == len(docs)
    n = spark.createDataFrame([(None, items[0][1] + " " + items[1][1])] * 2, "doc_id long, text string")
    assert len(dc.contaminated(n, b).collect()) in (1, 2) and dc.decontaminate(n, b).collect() == []
