"""Token counts: lengths only, from batch encoding in Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import id_and_text, worker_cache

#: A piece never has a word mark after another character, so no merge crosses a
#: space that follows something else; the next part gets its mark back as the
#: prefix that the library puts before every text.
_MARK = "▁"


def safe_parts(text: str, part_chars: int) -> list[str]:
    """Cut a long text before spaces where the encoding of both sides is independent; the space itself goes.

    Where there is no such space the part stays as long as it is.
    """
    if len(text) <= part_chars:
        return [text]
    parts, begin, n = [], 0, len(text)
    while n - begin > part_chars:
        at = begin + part_chars
        while True:
            at = text.find(" ", at)
            if at < 0 or at >= n - 1:
                at = -1
                break
            if at > begin and text[at - 1] not in (" ", _MARK):
                break
            at += 1
        if at < 0:
            break
        parts.append(text[begin:at])
        begin = at + 1
    parts.append(text[begin:])
    return parts


def _count(model_file: str, batch_bytes: int, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        cache = worker_cache()
        model = cache.get(("pieces", model_file))
        if model is None:
            model = cache[("pieces", model_file)] = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def lengths(parts: list[str], owners: list[int], out: list[int]) -> None:
            for owner, ids in zip(owners, model.encode(parts, num_threads=1)):
                out[owner] += len(ids)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, counts = [], [0] * len(texts)
            parts, owners, held = [], [], 0
            for row, text in enumerate(texts):
                text = text or ""
                # Batches are balanced by bytes: a script of three bytes a character takes three times the work.
                sizes.append(len(text.encode("utf-8")))
                for part in safe_parts(text, part_chars) if text else ():
                    parts.append(part)
                    owners.append(row)
                    held += sizes[-1] if part is text else len(part.encode("utf-8"))
                    if held >= batch_bytes:
                        lengths(parts, owners, counts)
                        parts, owners, held = [], [], 0
            if parts:
                lengths(parts, owners, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def count_tokens(df: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, part_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row's whole text under a piece model file.

    Nulls count as empty: 0 bytes, 0 tokens.  Repeated rows and null ids each
    give a row of their own; an empty table gives none; other columns are not
    read.  Batches for the library hold about `batch_bytes` bytes; a text
    over `part_chars` is cut at boundaries that no piece crosses, so the sum of
    the parts' counts is the count of the whole.
    """
    return id_and_text(df, id_col, text_col).mapInArrow(_count(model_file, batch_bytes, part_chars), "doc_id long, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
