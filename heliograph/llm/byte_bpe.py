"""Byte-level BPE: encoding with character offsets, and decoding."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.llm.common import bound_batches, release_memory, worker_cache

#: Memory bound of a worker's table of pretokens that it has seen.
MAX_SEEN = 250_000
SLICE_BYTES = 2 << 20
SEGMENT_CHARS = 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, extra = [], 0
    for b in range(256):
        table.append(chr(b if b in plain else 0x100 + extra))
        extra += b not in plain
    return table


def read_ranks(rank_file: str) -> dict[bytes, int]:
    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def build_tokenizer(ranks: dict[bytes, int]):
    """The library's byte-level model of a rank file.

    A rank file merges any neighbours whose concatenation has a rank, so every
    way to cut a token in two known parts becomes a merge at the token's rank.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = lambda token: "".join(shown[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        merges += [(name(token[:i]), name(token[i:])) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    model = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model


def _segments(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a very long text, cut between a non-space and a single space before a non-space: no match crosses there."""
    begin, n = 0, len(text)
    while n - begin > SEGMENT_CHARS:
        at = begin + SEGMENT_CHARS
        while at < n - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at += 1
        if at >= n - 1:
            break
        yield begin, text[begin:at]
        begin = at
    yield begin, text[begin:]


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        ranks = read_ranks(rank_file)
        self.rank_file, self.model = rank_file, None  # decoding needs no model
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.seen: dict[str, list[int]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Know the ids of all these pieces; the table is emptied before it would pass its bound."""
        new = pieces - self.seen.keys()
        if len(self.seen) + len(new) > MAX_SEEN:
            self.seen.clear()
            new = pieces
        if not new:
            return
        if self.model is None:
            # Spark runs a worker for each core; the library's own threads would only spin beside them.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.model = build_tokenizer(read_ranks(self.rank_file))
        listed = list(new)
        for piece, got in zip(listed, self.model.encode_batch_fast(listed, add_special_tokens=False)):
            self.seen[piece] = got.ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the library sees each distinct pretoken of the batch once."""
        cut = [[piece for _, part in _segments(t) for piece in self.split(part)] for t in texts]
        self.learn({p for pieces in cut for p in pieces})
        known = self.seen
        return [np.fromiter(chain.from_iterable([known[p] for p in pieces]), np.int32) for pieces in cut]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each token touches; a split character belongs to all its tokens."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = ends - [len(self.bytes_of[i]) for i in ids]
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return char_of[starts], char_of[ends - 1] + 1

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(rank_file: str, pattern: str) -> Codec:
    cache = worker_cache()
    key = ("codec", rank_file, pattern)
    if key not in cache:
        cache[key] = Codec(rank_file, pattern)
    return cache[key]


def _slices(batch: pa.RecordBatch, column: int, target: int) -> Iterator[pa.RecordBatch]:
    """Row slices of about `target` bytes each, one row at least."""
    rows, begin = batch.num_rows, 0
    if not rows:
        return
    per_row = max(1, batch.column(column).nbytes // rows)
    step = max(1, target // per_row)
    while begin < rows:
        yield batch.slice(begin, step)
        begin += step


def encode(df: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids array<int> of every whole text; with `offsets` also char_starts and char_ends.

    With `decoded` also what decode() makes of the ids, in the same pass.

    A null text is empty and has no ids.  Repeated rows and null ids each give
    a row; an empty table gives none.  The columns named in `keep` pass on as
    _keep0, _keep1 and so on; no others are read.
    """
    bound_batches(df.sparkSession)
    own_names = [f"_keep{i}" for i in range(len(keep))]
    base = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), *(df[c].alias(k) for c, k in zip(keep, own_names)))
    schema = "doc_id long, ids array<int>" + (", char_starts array<long>, char_ends array<long>" if offsets else "") + (", decoded binary" if decoded else "")
    schema += "".join(f", {k} {base.schema[k].dataType.simpleString()}" for k in own_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for whole in batches:
            for batch in _slices(whole, 1, SLICE_BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = own.encode(texts)
                columns = [batch.column(0), _lists(found, pa.int32())]
                if offsets:
                    spans = [own.offsets(t, ids) for t, ids in zip(texts, found)]
                    columns += [_lists([s for s, _ in spans], pa.int64()), _lists([e for _, e in spans], pa.int64())]
                if decoded:
                    columns.append(pa.array([own.decode(ids.tolist()) for ids in found], pa.binary()))
                names = ["doc_id", "ids", *["char_starts", "char_ends"] * offsets, *["decoded"] * decoded, *own_names]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names)
        release_memory()

    return base.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def decode(df: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes of the ids joined, so characters split between tokens come together again.

    Null ids count as an empty list and give no bytes.  An id outside the table is an error.
    `keep` names further columns to pass on as they are; they must not be named like the three.
    """
    base = df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids"), *keep)
    schema = "doc_id long, ids array<int>, decoded binary" + "".join(f", `{c}` {base.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            raw = [own.decode(flat[a:b].tolist()) if ok else b"" for a, b, ok in zip(at[:-1], at[1:], valid)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(raw, pa.binary()), *batch.columns[2:]], ["doc_id", "ids", "decoded", *keep])

    return base.mapInArrow(run, schema)
