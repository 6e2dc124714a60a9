"""Language-model scores by logistic context mixing over hashed contexts.

A token (lower-cased word, or the end of a text) is coded as BITS bits of its
hash, then as itself within that bucket by its training count; a word that
training never saw is spelt out byte by byte.  Each bit is predicted in four
contexts: none, the word before, the two words before, and the last very common
word.  The contexts' bit counts cover all training rows, in tables whose size
follows the number of training tokens.

In each text the predictors go on learning, from chunk to chunk: the first two
contexts add what this text taught them, the mixing weights (in sets gated by
how well known the contexts are) follow the coding error, and a last stage maps
the mixed probability to what came of such probabilities so far.  Every text
starts from the same state, so a score depends on the training rows and the text
alone.  The first weights are fitted on every bit of every training row: a pass
counts how often the contexts' evidence, in steps and without the bit itself,
comes together, and Newton steps go over these counts.  So are the letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import id_and_text, materialize, shared

BITS = 10
#: Bits of the tables of the two hashed contexts: a slot for 16 training tokens, between these bounds.
#: At the upper one a worker's tables take 70 MB; beyond it contexts share slots, as the README measures.
MIN_SLOT_BITS, MAX_SLOT_BITS = 18, 22
COMMON = 256
#: Words whose counts are broadcast at most (12 bytes each); the counts of all others are joined.
HEAD = 1 << 18
CONTEXTS = 4
BLOCK = 1 << 16
CHUNK = 32
SLICE_TOKENS = 50000
GATES = 12
FAN_IN = 256
END = b"\n"  # no word holds a line break
#: Steps of the weights, of a text's own tables, and of the last stage.
RATE, LEARN, REFINE = np.float32(0.002), np.float32(0.15), np.float32(0.02)
#: Slots of a text's own table for the word before; places of the last stage for each bit of a token.
OWN = 1 << 11
PLACES = 24
#: Steps of a context's evidence, and the bend of their scale, in the histogram that the first weights are fitted on.
STEPS, BEND = 12, math.asinh(6.0) / 12
LEVELS = 2 * STEPS + 1
#: What the codes of the contexts count: evidence, and for the two hashed ones how well they are known.
CODES = (LEVELS, 3 * LEVELS, 4 * LEVELS, LEVELS)
CELLS = math.prod(CODES)
#: Weights that the fit starts from, by context, where its counts are many.
START = (0.12, 0.4, 0.75, 0.55)
SLOT = np.dtype([("stretch", np.float32), ("known", np.int32)])
_PHI, _M = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Layout:
    """Sizes and places of the contexts' tables."""

    def __init__(self, slot_bits: int):
        self.slot_bits = slot_bits
        self.sizes = (1 << BITS, 1 << slot_bits, 1 << slot_bits, (COMMON + 1) << BITS)
        self.bases = tuple(sum(self.sizes[:i]) for i in range(CONTEXTS))
        self.total = sum(self.sizes)

    def slot(self, context: int, base: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Place of (context, bits so far) in the table of all contexts."""
        if context == 0:
            return node.astype(np.int64)
        if context == CONTEXTS - 1:
            return (base.astype(np.int64) << BITS) + node + self.bases[context]
        mixed = (base ^ (node * _PHI)) * _M
        return ((mixed ^ (mixed >> np.uint32(15))) * _PHI >> np.uint32(32 - self.slot_bits)).astype(np.int64) + self.bases[context]


def layout_for(tokens: int) -> Layout:
    return Layout(min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, (tokens >> 4).bit_length())))


def train_rows(df: DataFrame, parts: int, held: int) -> DataFrame:
    """The rows with `held_out`: crc32 of the id as text, modulo `parts`, equals `held`; a null id counts as the empty text."""
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == held)


class Tokens:
    """The tokens of a batch of texts: distinct ones with their hashes, and of each text's tokens the numbers of those.

    Texts lie by length, so that those which are scored side by side end together.
    """

    def __init__(self, texts: pa.Array):
        import pyarrow.compute as pc
        import xxhash

        # Only A-Z is lowered, and only ASCII white space cuts: as `words_of`, but by batch.
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        ends = cut.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(cut.values.slice(ends[0], ends[-1] - ends[0]))
        met, at = coded.dictionary, coded.indices.to_numpy()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(met)], pa.int32()), met.cast(pa.binary())), pa.scalar(END, pa.binary()))[0]
        self.words: list[bytes] = joined.as_py().split(END) if len(met) else []
        self.words.append(END)
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        if b"" in self.words:  # white space at a text's begin or end leaves an empty piece
            full = at != self.words.index(b"")
            at, row = at[full], row[full]
        lengths = np.bincount(row, minlength=len(texts)) + 1
        self.rows = np.argsort(lengths, kind="stable")
        self.lengths = lengths[self.rows]
        shift = np.empty(len(texts), np.int64)
        shift[self.rows] = np.cumsum(self.lengths) - self.lengths
        shift -= np.cumsum(lengths - 1) - (lengths - 1)
        self.tokens = np.full(len(at) + len(texts), len(self.words) - 1, np.int64)
        self.tokens[np.arange(len(at)) + shift.take(row)] = at
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers, lengths with the end counted, and tokens, some SLICE_TOKENS at a time."""
        ends, row = np.cumsum(self.lengths), 0
        while row < len(ends):
            begin = ends[row] - self.lengths[row]
            to = min(len(ends), int(np.searchsorted(ends, begin + SLICE_TOKENS)) + 1)
            yield self.rows[row:to], self.lengths[row:to], self.tokens[begin : ends[to - 1]]
            row = to


def _fold(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def common_places(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The place of each hash among the common words, COMMON for others."""
    place = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
    return np.where(common[place] == h, place, COMMON) if len(common) else np.full(len(h), COMMON)


def context_slots(h: np.ndarray, lengths: np.ndarray, common: np.ndarray, place: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """For each context a base value of every token, and the tokens' bucket codes; `place` is `common_places`, where known."""
    ends = np.cumsum(lengths)
    first = np.zeros(len(h), bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    one = np.concatenate((h[:1], h[:-1])).copy()
    one[first] = 1
    two = np.concatenate((one[:1], one[:-1])).copy()
    two[first] = 2
    place = common_places(h, common) if place is None else place
    # The last common word before each token, within its text.
    at = np.where(place < COMMON, np.arange(len(h)), -1)
    last = np.concatenate(([-1], np.maximum.accumulate(at)[:-1]))
    begin = np.repeat(ends - lengths, lengths)
    topic = np.where(last >= begin, place[np.maximum(last, 0)], COMMON).astype(np.uint32)
    return [np.zeros(0, np.uint32), _fold(one), _fold(one * np.uint64(0xC2B2AE3D27D4EB4F) + two), topic], (h & np.uint64((1 << BITS) - 1)).astype(np.uint32)


def letter_pairs(words: list[bytes], times: np.ndarray) -> np.ndarray:
    """How often a byte follows another in words that come so many times, a line break before and after each; the end of a text is no word."""
    raw = np.frombuffer(END + END.join(words) + END, np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    each = np.repeat(np.where(np.fromiter((w != END for w in words), bool, len(words)), times, 0), size)
    return np.bincount(raw[:-1].astype(np.int64) << 8 | raw[1:], weights=each, minlength=1 << 16).astype(np.int64) if words else np.zeros(1 << 16, np.int64)


def _count_words():
    """Rows of kind 0: words and their counts; of kind 1: pairs of bytes and theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            h, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return h, np.bincount(place, weights=np.concatenate([c for _, c in held]), minlength=len(h)).astype(np.int64)

        def rows(kind: int, h: np.ndarray, c: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], ["kind", "h", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            met = Tokens(batch.column(1))
            times = np.bincount(met.tokens, minlength=len(met.words))
            pairs += letter_pairs(met.words, times)
            used = times > 0
            held.append((met.hashes[used], times[used]))
            if sum(len(h) for h, _ in held) > 900_000:
                held = [summed()]
                if len(held[0][0]) > 300_000:
                    yield rows(0, *held.pop())
        if held:
            yield rows(0, *summed())
        met = np.flatnonzero(pairs)
        yield rows(1, met, pairs[met])

    return run


def _count_bits(common: np.ndarray, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(2 * layout.total, np.uint32)
        leaves = np.zeros((COMMON + 1) << BITS, np.uint32)
        used = False
        for batch in batches:
            met = Tokens(batch.column(1))
            place = common_places(met.hashes, common)
            for _, lengths, tokens in met.slices():
                used = True
                bases, code = context_slots(met.hashes.take(tokens), lengths, common, place.take(tokens))
                np.add.at(leaves, (bases[3].astype(np.int64) << BITS) + code, np.uint32(1))
                node, once = np.ones(len(code), np.uint32), np.ones(len(code), np.uint32)
                for level in range(BITS):
                    bit = (code >> np.uint32(BITS - 1 - level)) & np.uint32(1)
                    for c in (1, 2):
                        at = layout.slot(c, bases[c], node)
                        at <<= 1
                        at += bit
                        np.add.at(table, at, once)
                    node = node * np.uint32(2) + bit
        # The other two contexts have a place for every code: their nodes are sums of those.
        for c, own in ((0, leaves.reshape(-1, 1 << BITS).sum(0, dtype=np.uint32)[None, :]), (3, leaves.reshape(-1, 1 << BITS))):
            part = table[2 * layout.bases[c] : 2 * (layout.bases[c] + layout.sizes[c])].reshape(len(own), 2 << BITS)
            for level in range(BITS):
                part[:, 2 << level : 4 << level] = own.reshape(len(own), 2 << level, -1).sum(2, dtype=np.uint32)
        if used:
            yield from _blocks(table, TaskContext.get().partitionId() // FAN_IN)

    return run


def _blocks(table: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
    """A task's counts, block by block, without empty ones."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    for block in range(0, len(table), BLOCK):
        part = table[block : block + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([group], pa.int32()), pa.array([squeeze.compress(part.astype(np.uint64).tobytes())], pa.binary())], ["block", "part", "counts"])


def evidence_codes(counts: np.ndarray, layout: Layout) -> np.ndarray:
    """For each slot and each bit that may come there: the code of what the slot says for it, with this one bit taken out of its counts."""
    out = np.empty(2 * layout.total, np.uint8)
    for c in range(CONTEXTS):
        begin, end = 2 * layout.bases[c], 2 * (layout.bases[c] + layout.sizes[c])
        for at in range(begin, end, 1 << 20):
            pair = counts[at : min(end, at + (1 << 20))].astype(np.float32).reshape(-1, 2)
            for bit in (0, 1):
                came, other = np.maximum(pair[:, bit] - 1, 0), pair[:, 1 - bit]
                says = np.log(came + np.float32(0.4)) - np.log(other + np.float32(0.4))
                code = np.clip(np.rint(np.arcsinh(says / 2) / BEND), -STEPS, STEPS).astype(np.int64) + STEPS
                if c in (1, 2):
                    code += LEVELS * np.minimum(np.digitize(came + other, [1, 4, 32]), c + 1)
                out[at + bit : at + 2 * len(pair) : 2] = code
    return out


def _count_cells(common: np.ndarray, layout: Layout, get):
    """How often the four contexts' codes come together, over all bits of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, cells, used = get(), np.zeros(CELLS, np.uint32), False
        for batch in batches:
            met = Tokens(batch.column(1))
            place = common_places(met.hashes, common)
            for _, lengths, tokens in met.slices():
                used = True
                np.add.at(cells, cells_of(codes, layout, *context_slots(met.hashes.take(tokens), lengths, common, place.take(tokens))), np.uint32(1))
        if used:
            yield from _blocks(cells, TaskContext.get().partitionId() // FAN_IN)

    return run


def cells_of(codes: np.ndarray, layout: Layout, bases: list[np.ndarray], code: np.ndarray) -> np.ndarray:
    """The cell of every bit of tokens."""
    node, out = np.ones(len(code), np.uint32), np.zeros((BITS, len(code)), np.int32)
    said = np.empty(len(code), np.uint8)
    for level in range(BITS):
        bit = (code >> np.uint32(BITS - 1 - level)) & np.uint32(1)
        for c in (2, 1, 0, 3):
            at = layout.slot(c, bases[c], node)
            at <<= 1
            at += bit
            out[level] *= np.int32(CODES[c])
            out[level] += codes.take(at, out=said, mode="clip")
        node = node * np.uint32(2) + bit
    return out.ravel().astype(np.int64)


def fitted_weights(cells: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weight sets that maximise the likelihood of all counted bits, by Newton steps from the fixed start."""
    out = _start_weights().astype(np.float64)
    at = np.flatnonzero(cells)
    rest, last = np.divmod(at, CODES[3])
    rest, none = np.divmod(rest, CODES[0])
    two, one = np.divmod(rest, CODES[1])
    says = [2 * np.sinh(BEND * (k % LEVELS - STEPS)) for k in (none, one, two, last)]
    gate, times = one // LEVELS + 3 * (two // LEVELS), cells[at].astype(np.float64)
    for g in range(GATES):
        mine = gate == g
        x, n, start, w = np.stack([v[mine] for v in says], 1), times[mine], out[g].copy(), out[g].copy()
        loss = lambda w: float((n * np.logaddexp(0, -(x @ w))).sum() + 0.5 * ((w - start) ** 2).sum())
        now = loss(w)
        for _ in range(rounds):
            miss = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * miss * (1 - miss))[:, None]).T @ x + np.eye(CONTEXTS), x.T @ (n * miss) - (w - start))
            while loss(w + step) > now and np.abs(step).max() > 1e-6:
                step /= 2
            if np.abs(step).max() <= 1e-6:
                break
            w, now = w + step, loss(w + step)
        out[g] = w
    return out.astype(np.float32)


def _add_blocks():
    """Sums of blocks, streamed: rows come sorted by block, one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1] // FAN_IN], pa.int32()), pa.array([squeeze.compress(total.tobytes())], pa.binary())], ["block", "part", "counts"])

        for batch in batches:
            for block, part, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = np.frombuffer(loose.decompress(blob), np.uint64)
                if (block, part) != at:
                    if at is not None:
                        yield done()
                    at, total = (block, part), values.copy()
                else:
                    total += values
        if at is not None:
            yield done()

    return run


class Model:
    """What scoring needs of the training rows; every part has a bound, and only the joined word counts grow on."""

    def __init__(self, tokens: int, distinct: int, head: np.ndarray, head_counts: np.ndarray, buckets: np.ndarray, common: np.ndarray, counts: np.ndarray, layout: Layout, pairs: Sequence[int] = (), weights: np.ndarray | None = None):
        self.tokens, self.distinct, self.head, self.head_counts, self.common, self.layout = tokens, distinct, head, head_counts, common, layout
        self.bucket_cost = np.log10(buckets + 1.0)
        # What a slot says and how well it is known lie side by side: one look-up brings both.
        self.slots = np.zeros(layout.total, SLOT)
        for begin in range(0, layout.total, 1 << 20):
            zero, one = (counts[2 * begin + k : 2 * begin + (2 << 20) : 2].astype(np.float32) for k in (0, 1))
            self.stretch[begin : begin + (1 << 20)] = np.log(one + np.float32(0.4)) - np.log(zero + np.float32(0.4))
            self.known[begin : begin + (1 << 20)] = np.digitize(zero + one, [1, 4, 32])
        self.weights = _start_weights() if weights is None else weights
        self.letters = _letters(pairs)

    @property
    def stretch(self) -> np.ndarray:
        return self.slots["stretch"]

    @property
    def known(self) -> np.ndarray:
        return self.slots["known"]

    def spelling(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of the bytes of words, an end after each, under the letter table."""
        if not words:
            return np.zeros(0)
        raw = np.frombuffer(END + END.join(words) + END, np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.add.reduceat(self.letters[raw[:-1], raw[1:]], np.concatenate(([0], ends[:-1]))).astype(np.float64)


def _letters(pairs: Sequence[int]) -> np.ndarray:
    """Log10 probabilities of a byte after another one, a line break before and after each word."""
    counts = np.full((256, 256), 0.05)
    if len(pairs):
        counts += np.asarray(pairs).reshape(256, 256)
    return np.log10(counts / counts.sum(1, keepdims=True))


def _start_weights() -> np.ndarray:
    """Weight sets by gate (how known the two-word context is, 4, times the word before, 3): unknown contexts weigh little."""
    out = np.zeros((GATES, CONTEXTS), np.float32)
    for two in range(4):
        for one in range(3):
            trust = (1.0, (0.3, 0.7, 1.0)[one], (0.0, 0.45, 0.8, 1.0)[two], 1.0)
            rest = 1.0 + 0.6 * (1 - trust[2]) + 0.5 * (1 - trust[1])
            out[3 * two + one] = [START[0] * rest, START[1] * trust[1] * rest, START[2] * trust[2], START[3] * rest]
    return out


def places() -> np.ndarray:
    """What the last stage starts from: each place gives back the middle of its range."""
    return (np.arange(PLACES, dtype=np.float32) - np.float32(PLACES / 2 - 0.5)).astype(np.float32)


def bit_scores(model: Model, h: np.ndarray, lengths: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """Log10 probability of the tokens' bits, by text.

    Texts go side by side, chunk after chunk, the longest first: the chunks of
    one step lie together, so that a step works on views.  Within a step the
    first tokens of all texts come first, then the second ones: neighbours
    belong to different texts, and sums by text don't wait for each other.
    """
    bases, code = context_slots(h, lengths, model.common, common)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    chunks = -(-lengths[order] // CHUNK)
    steps = int(chunks[0]) if len(chunks) else 0
    live = np.searchsorted(-chunks, -np.arange(steps), side="left")  # texts with more than so many chunks
    offset = np.concatenate(([0], np.cumsum(live)))
    within = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    step, inner = within // CHUNK, within % CHUNK
    place = offset[step] * CHUNK + inner * live[step] + np.repeat(rank, lengths)  # of each token in the padded layout
    padded = int(offset[-1]) * CHUNK
    # Tokens move to their places once; what lies between texts counts for nothing (sign 0).
    def placed(values: np.ndarray) -> np.ndarray:
        out = np.zeros(padded, values.dtype)
        out[place] = values
        return out

    there, code, bases = placed(np.ones(len(h), np.float32)), placed(code), [bases[0], *map(placed, bases[1:])]
    owner = np.concatenate([np.tile(np.arange(n, dtype=np.int32), CHUNK) for n in live.tolist()]) if steps else np.zeros(0, np.int32)
    x = np.empty((CONTEXTS, BITS, padded), np.float32)
    sign = np.empty((BITS, padded), np.float32)
    gate = np.empty((BITS, padded), np.int32)
    own = np.empty((2, BITS, padded), np.int32)  # places in the texts' own tables
    node, both = np.ones(padded, np.uint32), np.empty(padded, np.int64)
    met = both.view(SLOT)
    for level in range(BITS):
        bit = (code >> np.uint32(BITS - 1 - level)) & np.uint32(1)
        sign[level] = (2 * bit.astype(np.float32) - 1) * there
        np.multiply(owner, GATES, out=gate[level])
        for c in range(CONTEXTS):
            slot = model.layout.slot(c, bases[c], node)
            model.slots.view(np.int64).take(slot, out=both, mode="clip")
            x[c, level] = met["stretch"]
            if c == 1:
                gate[level] += np.minimum(met["known"], 2)
                own[1, level] = owner * OWN + (slot & (OWN - 1))
            elif c == 2:
                gate[level] += 3 * met["known"]
        own[0, level] = (owner << BITS) + node.view(np.int32)
        node = node * np.uint32(2) + bit
    weights = np.ascontiguousarray(np.tile(model.weights, (len(lengths), 1)).T)
    learnt = np.zeros(len(lengths) << BITS, np.float32), np.zeros(len(lengths) * OWN, np.float32)
    last = np.tile(places(), len(lengths) * BITS)
    floors = (np.arange(BITS) * PLACES)[:, None, None]
    score = np.zeros(len(lengths))
    for step in range(steps):
        n, part = int(live[step]), slice(offset[step] * CHUNK, offset[step + 1] * CHUNK)
        g, s = gate[:, part].astype(np.intp), sign[:, part]
        mine = [own[c, :, part].astype(np.intp) for c in range(2)]
        now = [x[c, :, part] for c in range(CONTEXTS)]
        if step:
            now[0] = now[0] + learnt[0].take(mine[0], mode="clip")
            now[1] = now[1] + learnt[1].take(mine[1], mode="clip")
        mixed = weights[0].take(g, mode="clip") * now[0]
        for c in range(1, CONTEXTS):
            term = weights[c].take(g, mode="clip")
            term *= now[c]
            mixed += term
        np.clip(mixed, np.float32(-11.9), np.float32(11.9), out=mixed)
        at = (mixed + np.float32(PLACES / 2)).astype(np.intp).reshape(BITS, CHUNK, n)
        at += floors + np.arange(n) * (BITS * PLACES)
        at = at.reshape(BITS, -1)
        # Between what the mixer says and what came of it so far.
        mixed += last.take(at, mode="clip")
        mixed *= np.float32(0.5)
        mixed *= s
        np.negative(mixed, out=mixed)
        right = np.exp(mixed, out=mixed)  # probability of the bit that came
        right += 1
        np.reciprocal(right, out=right)
        # Four bits to a logarithm, and two: no such product is too small for a float.
        two = right[: BITS // 2] * right[BITS // 2 :]
        logs = np.log(two[:2] * two[2:4]).sum(0) + np.log(two[4])
        score[:n] += (logs * there[part]).reshape(CHUNK, n).sum(0, dtype=np.float64)
        if step + 1 == steps:
            break
        # Texts that go on learn from this chunk.
        more = int(live[step + 1])

        def on(values: np.ndarray) -> np.ndarray:
            return values if more == n else values.reshape(BITS, CHUNK, n)[:, :, :more]

        miss = on((1 - right) * s)
        flat = on(g).ravel()
        for c in range(CONTEXTS):
            weights[c, : more * GATES] += RATE * np.bincount(flat, weights=(miss * on(now[c])).ravel(), minlength=more * GATES)
        err = miss.ravel()
        learn = LEARN * err
        for table, where in zip(learnt, mine):
            np.add.at(table, on(where).ravel(), learn)
        np.add.at(last, on(at).ravel(), REFINE * err)
    out = np.zeros(len(lengths))
    out[order] = score / math.log(10)
    return out


def _score(get):
    names = ["doc_id", "doc_key", "held_out", "n_bytes", "n_tokens", "n_known", "known_cost", "bits_cost", "tail", "tail_times", "tail_spelling"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        model: Model = get()
        for batch in batches:
            met = Tokens(batch.column(1))
            raws = [raw or b"" for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            # What a token costs is looked up once for each distinct one of the batch.
            at = np.minimum(np.searchsorted(model.head, met.hashes), max(0, len(model.head) - 1))
            heads = model.head[at] == met.hashes if len(model.head) else np.zeros(len(at), bool)
            costs = np.where(heads, np.log10(model.head_counts[at] + 1.0) if len(model.head) else 0.0, 0.0)
            buckets = model.bucket_cost[(met.hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            place = common_places(met.hashes, model.common)
            spelt, away = np.zeros(len(at)), np.flatnonzero(~heads)
            spelt[away] = model.spelling([met.words[i] for i in away.tolist()])
            for rows, lengths, tokens in met.slices():
                bits = bit_scores(model, met.hashes.take(tokens), lengths, place.take(tokens))
                in_head, cost, bucket = heads.take(tokens), costs.take(tokens), buckets.take(tokens)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                out = []
                for i, row in enumerate(rows.tolist()):
                    part = slice(begins[i], ends[i])
                    mine, times = np.unique(tokens[part][~in_head[part]], return_counts=True)
                    raw = raws[row]
                    out.append((ids[row], xxhash.xxh3_64_intdigest(raw) & 0x7FFFFFFFFFFFFFFF, held[row], len(raw), int(lengths[i]), int(in_head[part].sum()), float(cost[part].sum()), float(bits[i] - bucket[part].sum()), met.hashes[mine].view(np.int64), times, spelt[mine]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def train(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The bounded model and the whole table (h, c) of training counts of (doc_id, text) rows."""
    spark = rows.sparkSession
    counted = rows.select("doc_id", "text").mapInArrow(_count_words(), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))
    counted = materialize(counted, "token_counts")
    counts = counted.where("kind = 0").select("h", "c")
    pairs = np.zeros(1 << 16, np.int64)
    for r in counted.where("kind = 1").select("h", "c").collect():
        pairs[r["h"]] = r["c"]
    ranks = counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    tokens, distinct = sum(r["c"] for r in ranks), sum(r["n"] for r in ranks)
    size, least = 0, 1 << 62
    for r in sorted(ranks, key=lambda r: -r["k"]):
        if size + r["n"] > HEAD:
            break
        size, least = size + r["n"], 1 << r["k"]
    head = counts.where(F.col("c") >= least).toPandas()
    keys, times = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    common = np.sort(keys[np.lexsort((keys, -times))[:COMMON]])
    buckets = np.zeros(1 << BITS)
    for r in counts.groupBy(F.col("h").bitwiseAND((1 << BITS) - 1).alias("b")).agg((F.sum("c") + F.count("*")).alias("n")).collect():
        buckets[r["b"]] = r["n"]
    layout = layout_for(tokens)
    # Counts are kept up to 2**31: more change no probability that is coded.
    table = _summed(rows.select("doc_id", "text").mapInArrow(_count_bits(common, layout), _BLOCKS), 2 * layout.total)
    get = shared(spark, evidence_codes(table, layout))
    cells = _summed(rows.select("doc_id", "text").mapInArrow(_count_cells(common, layout, get), _BLOCKS), CELLS, np.uint64)
    return Model(tokens, distinct, keys, times, buckets, common, table, layout, pairs, fitted_weights(cells)), counts


_BLOCKS = "block int, part int, counts binary"


def _summed(blocks: DataFrame, size: int, kind: type = np.uint32) -> np.ndarray:
    """The tasks' blocks added up; sums of the narrow kind up to 2**31."""
    import zstandard

    for _ in range(2):
        blocks = blocks.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_add_blocks(), _BLOCKS)
    loose, out = zstandard.ZstdDecompressor(), np.zeros(size, kind)
    for r in materialize(blocks, "counts").toLocalIterator():
        part = np.frombuffer(loose.decompress(bytes(r["counts"])), np.uint64)
        place = slice(r["block"] * BLOCK, r["block"] * BLOCK + len(part))
        out[place] = np.minimum(out[place] + part, 1 << 31) if kind is np.uint32 else part + out[place]
    return out


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelling, n_bytes, bits_per_byte of every row.

    Training rows are those with held_out false.  A null text is empty: its one
    token is the end.  Repeated rows train and are scored each; a null id counts
    as the empty text for the split.  With no training rows every bit starts at
    probability one half and base_score is 0.  score codes the tokens as base_score
    does, words that training never saw as one sort; spelling is what their bytes
    add.  bits_per_byte is both in bits over the bytes of the text (white space
    and case are not coded), null without bytes.
    Word counts are keyed by 64-bit hashes.
    """
    docs = train_rows(id_and_text(df, id_col, text_col), parts, held)
    model, counts = train(docs.where("NOT held_out"))
    kinds = "doc_id long, doc_key long, held_out boolean, n_bytes long, n_tokens long, n_known long, known_cost double, bits_cost double, tail array<long>, tail_times array<long>, tail_spelling array<double>"
    rows = materialize(docs.mapInArrow(_score(shared(docs.sparkSession, model)), kinds), "scored")
    key = ["doc_id", "doc_key", "held_out"]
    tail = rows.select(*key, F.explode(F.arrays_zip("tail", "tail_times", "tail_spelling")).alias("t")).select(*key, F.col("t.tail").alias("h"), F.col("t.tail_times").alias("times"), F.col("t.tail_spelling").alias("spelling"))
    unseen = F.col("c").isNull()
    found = tail.join(counts, "h", "left").groupBy(*key).agg(
        F.sum(F.when(unseen, 0).otherwise(F.col("times"))).alias("n_known"), F.sum(F.when(unseen, 0.0).otherwise(F.col("times") * F.log10(F.col("c") + 1))).alias("known_cost"),
        F.sum(F.when(unseen, F.col("times") * F.col("spelling")).otherwise(0.0)).alias("spelling"),
    )
    lead = rows.select(*key, "n_bytes", "n_tokens", "n_known", "known_cost", "bits_cost", F.lit(0.0).alias("spelling"), F.lit(1).alias("rows"))
    none = [F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_tokens")]
    both = lead.unionByName(found.select(*key, *none, "n_known", "known_cost", F.lit(0.0).alias("bits_cost"), "spelling", F.lit(0).alias("rows")))
    total = both.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "known_cost", "bits_cost", "spelling", "rows")))
    # Equal rows share a key: each gets its share of their sum.
    each = total.select(*key, *((F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_bytes", "n_tokens", "n_known")), *((F.col(c) / F.col("rows")).alias(c) for c in ("known_cost", "bits_cost", "spelling")), F.explode(F.sequence(F.lit(1), "rows")))
    floor = math.log10(model.tokens + model.distinct + 1)
    out = each.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("known_cost") - F.col("n_tokens") * floor).alias("base_score"), (F.col("known_cost") + F.col("bits_cost")).alias("score"), "spelling", "n_bytes",
    )
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -(F.col("score") + F.col("spelling")) * math.log2(10) / F.col("n_bytes")))
