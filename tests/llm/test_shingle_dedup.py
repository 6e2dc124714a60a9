import random

import numpy as np

import corpus_pipeline
from heliograph.llm import shingle_dedup, simhash_dedup


def plain(rows):
    """The same by comparing all pairs of shingle sets."""
    sets = [(i, set(shingle_dedup.shingles(t).tolist())) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa == sb or a == b or (sa and sb and len(sa & sb) >= 0.8 * len(sa | sb)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def edited(seed=5):
    """Texts, and chains of copies with a few words changed; most pairs differ in more than three SimHash bits."""
    rng = random.Random(seed)
    rows = []
    for group in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for copy in range(4):
            rows.append((10 * group + copy, " ".join(words)))
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[at] = f"x{rng.randrange(5000)}"
    return rows


def test_edited_copies_equal_brute_force(spark, edge_rows, corpus, monkeypatch):
    for rows, block in ((edited(), 500), (edited(), 2), (edge_rows, 500), ([(r.doc_id, r.text) for r in corpus.collect()], 500)):
        monkeypatch.setattr(shingle_dedup, "BLOCK", block)
        got = {(r.doc_id, r.component_id) for r in shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {x for x in got if x[0] is not None} == set(plain(rows).items())


def test_fingerprints_in_vantage_point_shards_propose(spark, monkeypatch):
    """Without any band, pairs within three bits that are similar enough are linked, and only those."""
    monkeypatch.setattr(shingle_dedup, "_bands", lambda grams: np.array([random.getrandbits(62)]))
    rng, rows = random.Random(9), []
    for group in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(2 * group, " ".join(words)), (2 * group + 1, " ".join([*words[:-1], "other"]))]
    prints = {i: simhash_dedup.majority(shingle_dedup.shingles(t)) for i, t in rows}
    close = {i for i in range(0, 80, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 3}
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(close) > 20 and got == {i: i - 1 if i % 2 and i - 1 in close else i for i, _ in rows}


def test_the_stage_drops_edited_copies(spark):
    rows = edited()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    groups = plain(rows)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, least in groups.items() if i == least)


def test_common_counts(monkeypatch):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 90, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in rng.integers(1, 60, 40)] + [np.zeros(0, np.uint64)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    for size, columns in ((2_000_000, 4096), (50, 7)):
        monkeypatch.setattr(shingle_dedup, "PASS", size)
        monkeypatch.setattr(shingle_dedup, "COLUMNS", columns)
        own = shingle_dedup.common_counts(sets)
        off = ~np.eye(len(sets), dtype=bool)
        assert (own == want)[off].all()
        assert (shingle_dedup.common_counts(sets[:9], sets[9:]) == want[:9, 9:]).all()
