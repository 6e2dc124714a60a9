import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import xxhash

from heliograph.llm import byte_bpe, quality_rules, simhash_dedup, substring_dedup, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
key = lambda r: (r[0] is None, r)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, *map(str, r)))


@pytest.mark.parametrize("part_chars", [40, 1 << 16])
def test_token_counts_equal_the_library(edge_docs, corpus, part_chars):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (edge_docs, corpus):
        got = by_id(token_counts.count_tokens(docs, PIECES, part_chars=part_chars, batch_bytes=500).collect())
        assert got == by_id((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows_of(docs))


def test_safe_parts_on_random_texts():
    import sentencepiece

    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("ab  \n▁é.日") for _ in range(rng.randint(0, 60)))
        assert sum(len(model.encode(p)) for p in token_counts.safe_parts(text, 7)) == len(model.encode(text)), repr(text)


def test_byte_bpe_equals_tiktoken_and_round_trips(edge_docs, corpus):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (edge_docs, corpus):
        got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
        assert by_id((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == by_id((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows_of(docs))


def test_byte_bpe_random_and_segments(monkeypatch):
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    monkeypatch.setattr(byte_bpe, "SEGMENT_CHARS", 9)
    monkeypatch.setattr(byte_bpe, "MAX_SEEN", 50)
    texts = ["".join(rng.choice("abeht   éß\n\t　😀12.,!#-'s日本\x1c\x85") for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == own.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_offsets(spark):
    text = "naïve 😀 日本語 end"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    row, empty = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, offsets=True).orderBy("doc_id").collect()
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    assert empty.ids == [] and empty.char_starts == []
    covered = set()
    for i, a, b in zip(row.ids, row.char_starts, row.char_ends):
        assert codec.bytes_of[i] in text[a:b].encode()
        covered.update(range(a, b))
    assert covered == set(range(len(text)))


def test_substring_dedup_equals_brute_force(spark, edge_docs, corpus):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 20, 50, 300)]
    rows = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for part in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = part
        rows.append((rng.randint(0, 140), " ".join(text)))
    rows += [(200 + i, "loop " * 30) for i in range(5)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for docs in (edge_docs, corpus, made):
        got = substring_dedup.substring_dedup(docs).collect()
        got = by_id((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
        assert got == by_id(substring_dedup.brute_force(rows_of(docs)))


def test_substring_dedup_moves_only_texts_with_hits(spark, monkeypatch):
    """Texts without a hit are done where they are read; those that travel, and those a full filter sends, come out alike."""
    rng = random.Random(5)
    shared = " ".join(f"c{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) + (" " + shared if i < 20 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved = spark.sparkContext.accumulator(0)
    cut = substring_dedup._cut

    def counting(window):
        inner = cut(window)

        def run(batches):
            for batch in batches:
                moved.add(batch.num_rows)
                yield from inner(iter([batch]))

        return run

    monkeypatch.setattr(substring_dedup, "_cut", counting)
    for full in (False, True):
        if full:
            monkeypatch.setattr(substring_dedup, "FILTER_BITS", 64)
            monkeypatch.setattr(substring_dedup, "MAX_FILTER_BITS", 64)
        was = moved.value
        got = substring_dedup.substring_dedup(docs).collect()
        got = by_id((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
        assert got == by_id(substring_dedup.brute_force(rows))
        assert full or moved.value - was < 25


def test_substring_dedup_state_crosses_batches(spark, corpus):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, " ".join(f"s{j + i % 3}" for j in range(40))) for i in range(40)]
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        got = by_id((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
        assert got == by_id(substring_dedup.brute_force(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_plain_form(edge_rows):
    for _, text in edge_rows:
        assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


def plain_components(rows, most=3):
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, fa in rows:
        for b, fb in rows:
            if (fa ^ fb).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(edge_docs, corpus):
    for docs in (edge_docs, corpus):
        rows = rows_of(docs)
        prints = [(i, simhash_dedup.fingerprint(t)) for i, t in rows]
        want = plain_components([p for p in prints if p[0] is not None])
        got = by_id((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect())
        assert got == by_id((i, f, want.get(i)) for i, f in prints)


def test_shards_find_every_pair(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for base in list(prints)[:120]:
        chain = base
        for _ in range(rng.randint(1, 6)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                chain ^= 1 << bit
            prints.add(chain)
    prints = list(prints)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    from heliograph.llm.common import components

    label = {r.node: r.label for r in components(simhash_dedup.link_table(nodes, leaf=16)).collect()}
    want = plain_components(list(enumerate(prints)))
    assert {i: label.get(i, i) for i in range(len(prints))} == want
    assert len(set(want.values())) < len(prints)


def test_dense_group_of_fingerprints():
    import numpy as np

    fps = np.arange(5000, dtype=np.uint64)
    u, v = simhash_dedup._local_links(fps, np.arange(5000), 3)
    assert set(u) == {0} and len(v) == 4999


def test_shards_stay_bounded_as_fingerprints_grow():
    import numpy as np

    def cost(total):
        """Largest shard, and comparisons a fingerprint, of one tree over uniform fingerprints."""
        fps = np.random.default_rng(total).integers(0, 1 << 63, total, dtype=np.uint64) * np.uint64(2)
        codes = (fps & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        tree = simhash_dedup.Tree(np.sort(codes[: simhash_dedup.sample_size(total)]), 1, total, 1024)
        shards = [at for _, at in tree.leaves(codes)]
        some = shards[:: max(1, len(shards) // 20)]
        pairs = sum(len(b) ** 2 for at in some for b in simhash_dedup.buckets(fps[at], 3, 0)) / sum(map(len, some))
        return max(map(len, shards)), pairs * sum(map(len, shards)) / total

    (small, few), (large, many) = cost(100_000), cost(800_000)
    assert large < 2 * 1024 and large < 1.5 * small and many < 2 * few


def test_one_half_alike():
    import numpy as np

    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 32, 6_000, dtype=np.uint64) << np.uint64(32))
    near = fps[:500] ^ (np.uint64(7) << np.uint64(40))
    fps = np.unique(np.concatenate((fps, near)))
    u, v = simhash_dedup._local_links(fps, np.arange(len(fps)), 3, 0)
    where = {int(f): i for i, f in enumerate(fps)}
    group = dict(zip(v.tolist(), u.tolist()))
    assert all(group.get(where[int(a)], where[int(a)]) == group.get(where[int(a) ^ (7 << 40)], where[int(a) ^ (7 << 40)]) for a in near)


def test_quality_counts_equal_the_plain_form(edge_docs, corpus):
    def plain(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 2000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, inside if inside is None else len(inside)

    for docs in (edge_docs, corpus):
        seen = {(r.doc_id, r.n_words): r for r in quality_rules.apply_rules(docs).collect()}
        for i, text in rows_of(docs):
            n, chars, symbols, dup, repeats = plain(text)
            r = seen[(i, n)]
            assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (chars, symbols, dup)
            assert repeats is None or r.n_repeat_words == repeats
            assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n)
            assert not (r.base_failed and r.kept)


def test_line_rules():
    rules = quality_rules.Rules()
    fails = lambda line, seen=False: quality_rules.line_fails(line, line.split(), seen, rules)
    assert fails("Home | About | News | Help") and fails("thnt### ea$$$ of*** to%%%") and fails("THE!! BIG!! SALE!! IS!! ON!!")
    assert fails("Please accept all cookies") and fails("A line of several words.", True)
    assert not fails("A line of several words.") and not fails("Costs rose by 5% in May & June, they said to me at length.")
    assert fails("it it it it on on on on") and not fails("that that is is not")
    assert not fails("Released under the MIT License.")


def test_empty_tables(no_docs):
    ranks = (RANKS, public_tokenizers.PATTERN)
    for out in (token_counts.count_tokens(no_docs, PIECES), byte_bpe.decode(byte_bpe.encode(no_docs, *ranks), *ranks), substring_dedup.substring_dedup(no_docs), simhash_dedup.near_duplicates(no_docs), quality_rules.apply_rules(no_docs)):
        assert out.collect() == []
