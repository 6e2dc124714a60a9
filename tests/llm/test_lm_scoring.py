import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from heliograph.llm import lm_scoring as lm
from heliograph.llm.common import words_of


def plain(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    cut = [words_of(t, lower=True) + [b"\n"] for _, t in rows]
    seen = Counter(w for words, h in zip(cut, held) if not h for w in words)
    total, distinct = sum(seen.values()), len(seen)
    return [(i, h, len(words), sum(w in seen for w in words), total, sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in words)) for (i, _), h, words in zip(rows, held, cut)]


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_base_score_equals_the_plain_form(edge_docs, corpus, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    for docs in (edge_docs, corpus):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs).collect()), key=order)
        want = sorted(plain(rows), key=order)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_the_model_beats_the_base_on_held_out_rows(corpus):
    rows = [r for r in lm.score(corpus).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 and (r.n_bytes == 0 or r.bits_per_byte > 0) for r in rows)


def model_of(counts, layout, common=(), texts=()):
    return lm.Model(10, 5, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << lm.BITS), np.array(common, np.uint64), counts, layout, list(texts))


SMALL = lm.Layout(12)


def test_bit_probabilities_sum_to_one():
    """Over all codes of the last token, within a chunk and after chunks that were learnt from."""
    rng = np.random.default_rng(1)
    model = model_of(rng.integers(0, 50, 2 * SMALL.total).astype(np.uint32), SMALL)
    for past in (np.array([17, 99, 1234], np.uint64), rng.integers(0, 50, 3 * lm.CHUNK + 5).astype(np.uint64)):
        texts = [np.append(past, np.uint64(code)) for code in range(1 << lm.BITS)]
        whole = lm.bit_scores(model, np.concatenate(texts), np.full(len(texts), len(past) + 1))
        before = lm.bit_scores(model, past, np.array([len(past)]))[0]
        assert abs((10 ** (whole - before)).sum() - 1) < 1e-3


def plain_bits(model, h):
    """One text bit by bit, with dictionaries."""
    bases, code = lm.context_slots(h, np.array([len(h)]), model.common)
    weights, own, last, total = [[float(v) for v in w] for w in model.weights], [{}, {}], {}, 0.0
    for begin in range(0, len(h), lm.CHUNK):
        learnt = []
        for i in range(begin, min(len(h), begin + lm.CHUNK)):
            node = 1
            for level in range(lm.BITS):
                bit = int(code[i]) >> (lm.BITS - 1 - level) & 1
                at = [int(model.layout.slot(c, bases[c][i : i + 1], np.array([node], np.uint32))[0]) for c in range(lm.CONTEXTS)]
                places = (node, at[1] % lm.OWN)
                x = [float(model.stretch[a]) for a in at]
                for c in (0, 1):
                    x[c] += own[c].get(places[c], 0.0)
                gate = min(int(model.known[at[1]]), 2) + 3 * int(model.known[at[2]])
                mixed = max(-11.9, min(11.9, sum(w * v for w, v in zip(weights[gate], x))))
                place = (level, int(mixed + lm.PLACES / 2))
                final = (mixed + last.get(place, place[1] - (lm.PLACES / 2 - 0.5))) / 2
                p = 1 / (1 + math.exp(-final))
                total += math.log10(p if bit else 1 - p)
                learnt.append((gate, x, places, place, bit - p))
                node = 2 * node + bit
        for gate, x, places, place, miss in learnt:
            weights[gate] = [w + float(lm.RATE) * miss * v for w, v in zip(weights[gate], x)]
            for c in (0, 1):
                own[c][places[c]] = own[c].get(places[c], 0.0) + float(lm.LEARN) * miss
            last[place] = last.get(place, place[1] - (lm.PLACES / 2 - 0.5)) + float(lm.REFINE) * miss
    return total


def test_scores_equal_the_plain_form():
    rng = np.random.default_rng(4)
    model = model_of(rng.integers(0, 30, 2 * SMALL.total).astype(np.uint32), SMALL, common=range(9))
    texts = [rng.integers(0, 40, n).astype(np.uint64) for n in (1, 31, 32, 33, 150)]
    got = lm.bit_scores(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, [plain_bits(model, t) for t in texts], rtol=1e-3)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    model = model_of(rng.integers(0, 9, 2 * SMALL.total).astype(np.uint32), SMALL, common=range(20))
    texts = [rng.integers(0, 60, n).astype(np.uint64) for n in (1, 5, 200, 33, 32, 700)]
    together = lm.bit_scores(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(together, [lm.bit_scores(model, t, np.array([len(t)]))[0] for t in texts], rtol=1e-5)


def test_tokens_of_a_batch_are_the_words_of_its_texts():
    """White space of ASCII only, at both ends too; only A-Z lowered; nulls and empty texts; a batch that is part of an array."""
    import xxhash

    odd = [" Aa\x0bbB\x0c\tc \r\n", "", None, "  \n ", "\u00c4b\u00a0c\u2003D \x1cq\x85 \u0130", "\x00A b\x00", "x", "\U0001f600 X x " * 30]
    for texts in (odd, [], [None], odd[::-1] * 3):
        for column in (pa.array(texts, pa.string()), pa.array(["cut off", *texts], pa.string())[1:], pa.array(texts, pa.large_string())):
            met = lm.Tokens(column)
            got = {}
            for rows, lengths, tokens in met.slices():
                for row, part in zip(rows.tolist(), np.split(tokens, np.cumsum(lengths)[:-1])):
                    got[row] = [met.words[i] for i in part]
            assert [got[i] for i in range(len(texts))] == [words_of(t, lower=True) + [b"\n"] for t in texts]
            assert met.hashes.tolist() == [xxhash.xxh3_64_intdigest(w) for w in met.words] and len(set(met.words)) == len(met.words)


def test_texts_scored_side_by_side_end_together(monkeypatch):
    """Long texts share slices, so that not every slice takes the steps of a long one; the scores come back to their rows."""
    rng = np.random.default_rng(9)
    sizes = [1000 if i % 40 == 0 else 200 for i in range(400)]
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 90, n)) for n in sizes]
    model = model_of(rng.integers(0, 9, 2 * SMALL.total).astype(np.uint32), SMALL)
    steps, plain_form = [], lm.bit_scores
    monkeypatch.setattr(lm, "bit_scores", lambda m, h, lengths, *rest: steps.append(-(-int(lengths.max()) // lm.CHUNK)) or plain_form(m, h, lengths, *rest))
    monkeypatch.setattr(lm, "SLICE_TOKENS", 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.array([False] * 400)], ["doc_id", "text", "held_out"])
    got = {r["doc_id"]: r for out in lm._score(lambda: model)(iter([batch])) for r in out.to_pylist()}
    assert [got[i]["n_tokens"] for i in range(400)] == [n + 1 for n in sizes] and [got[i]["n_bytes"] for i in range(400)] == list(map(len, texts))
    assert sum(steps) < 150  # in the order of rows: 263
    h = [lm.Tokens(pa.array([t])) for t in texts[:45]]
    alone = [plain_form(model, t.hashes.take(t.tokens), t.lengths)[0] for t in h]
    assert np.allclose([got[i]["bits_cost"] for i in range(45)], alone, rtol=1e-5)


def test_tables_grow_with_the_tokens():
    assert [lm.layout_for(n).slot_bits for n in (0, 10**6, 10**7, 10**9)] == [18, 18, 20, 22]


def test_first_weights_and_letters_come_from_every_training_row(spark, monkeypatch):
    """Every bit of every row is in the fit, those of long texts and of more than a few hundred too; letters are counted over all words."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, n)) for n in [*rng.integers(0, 40, 700), 9000]] + [None, "Zz zz"]
    seen, fit = [], lm.fitted_weights
    monkeypatch.setattr(lm, "fitted_weights", lambda cells: seen.append(cells) or fit(cells))
    model, _ = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    cut = [words_of(t, lower=True) for t in texts]
    assert int(seen[0].sum()) == lm.BITS * model.tokens == lm.BITS * sum(len(words) + 1 for words in cut)
    pairs = Counter(p for words in cut for w in words for p in zip(b"\n" + w, w + b"\n"))
    counts = np.full((256, 256), 0.05)
    for p, n in pairs.items():
        counts[p] += n
    assert np.allclose(model.letters, np.log10(counts / counts.sum(1, keepdims=True)))


def test_cells_equal_the_plain_form():
    """Evidence without the bit itself, from counts of these very texts; the tables' sums for nodes as well."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 30, n).astype(np.uint64) * np.uint64(7919) for n in (1, 40, 90)]
    h, lengths, common = np.concatenate(texts), np.array(list(map(len, texts))), np.sort(np.unique(np.concatenate(texts))[:6])
    bases, code = lm.context_slots(h, lengths, common)
    counts, bits = np.zeros(2 * SMALL.total, np.uint32), []
    for i in range(len(h)):
        node = 1
        for level in range(lm.BITS):
            bit = int(code[i]) >> (lm.BITS - 1 - level) & 1
            bits.append((level, i, [int(SMALL.slot(c, bases[c][i : i + 1], np.array([node], np.uint32))[0]) for c in range(lm.CONTEXTS)], bit))
            for at in bits[-1][2]:
                counts[2 * at + bit] += 1
            node = 2 * node + bit
    got = lm.cells_of(lm.evidence_codes(counts, SMALL), SMALL, bases, code).reshape(lm.BITS, -1)
    for level, i, at, bit in bits:
        pairs = [(int(counts[2 * a + bit]) - 1, int(counts[2 * a + 1 - bit])) for a in at]
        steps = [round(math.asinh(math.log((n + 0.4) / (o + 0.4)) / 2) / lm.BEND) + lm.STEPS for n, o in pairs]
        known = [sum(n + o >= limit for limit in (1, 4, 32)) for n, o in pairs]
        one, two = lm.LEVELS * min(known[1], 2) + steps[1], lm.LEVELS * known[2] + steps[2]
        assert got[level, i] == ((two * lm.CODES[1] + one) * lm.CODES[0] + steps[0]) * lm.CODES[3] + steps[3]


def test_fitted_weights_are_the_best():
    rng = np.random.default_rng(8)
    cells = np.bincount(rng.integers(0, lm.CELLS, 60_000), minlength=lm.CELLS)
    w = lm.fitted_weights(cells)

    def loss(w):
        at = np.flatnonzero(cells)
        two, one, none, last = np.unravel_index(at, (lm.CODES[2], lm.CODES[1], lm.CODES[0], lm.CODES[3]))
        x = np.stack([2 * np.sinh(lm.BEND * (k % lm.LEVELS - lm.STEPS)) for k in (none, one, two, last)])
        gate = one // lm.LEVELS + 3 * (two // lm.LEVELS)
        return (cells[at] * np.logaddexp(0, -(w.T[:, gate].astype(float) * x).sum(0))).sum() + 0.5 * ((w.astype(float) - lm._start_weights()) ** 2).sum()

    assert all(loss(w) < loss(w + d) for d in 0.02 * rng.standard_normal((20, lm.GATES, lm.CONTEXTS)))


def test_learning_within_a_text_pays_off():
    """A text that repeats itself costs less a token the longer it goes on."""
    rng = np.random.default_rng(3)
    model = model_of(np.zeros(2 * SMALL.total, np.uint32), SMALL)
    once = rng.integers(0, 1 << 60, 64).astype(np.uint64)
    one, many = lm.bit_scores(model, np.concatenate((once, np.tile(once, 20))), np.array([64, 64 * 20]))
    assert many / 20 > one * 0.8


def test_unseen_words_are_spelt(spark):
    rows = [(i, "the cat sat on the mat and the dog ran") for i in range(40)]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][-2:]
    df = spark.createDataFrame(rows + [(held[0], "the cat qq"), (held[1], "the cat qqqqqqqqqqqqqqqq")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df).collect()}
    assert got[held[0]].n_known == got[held[1]].n_known == 3 and got[held[1]].spelling < got[held[0]].spelling - 5 < -5 and got[held[1]].bits_per_byte > 0


def test_no_training_row(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    rows = lm.score(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == 5 and all(r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in rows)


def test_empty_table(no_docs):
    assert lm.score(no_docs).collect() == []
