"""Quality rules, line first: bad lines go, then documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches, release_memory, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Phrases of page furniture, matched in the lower-cased line.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot your password",
    "log in to", "privacy policy", "read more", "share this", "sign up for", "skip to content", "subscribe to", "terms of service",
)
_UPPER, _LOWER = re.compile("[A-Z]"), re.compile("[a-z]")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: A line fails as symbols when this share of its word characters are symbols.
    max_symbol_percent: int = 10
    #: A line fails as navigation from so many separators (| words) and one for each `words_per_bar` words.
    min_bars: int = 3
    words_per_bar: int = 6
    #: A line fails as shouting from so many words with ! marks, nearly all of its ASCII letters capitals.
    min_shout_words: int = 5
    #: A line fails as stutter from so many words when half of them repeat the word before.
    min_stutter_words: int = 8
    #: A document goes when more than this share of its word characters was in failed lines.
    max_lost_percent: int = 50


def line_fails(line: str, words: list[str], seen: bool, rules: Rules) -> bool:
    """Whether a line with words fails; `seen`: an equal line stands before it.

    A repeated line of at least `min_bars` words is boilerplate, as are known
    phrases of page furniture in lines of up to 12 words.
    """
    chars = sum(map(len, words))
    symbols = sum(line.count(c) for c in SYMBOLS)
    if 100 * symbols > rules.max_symbol_percent * chars:
        return True
    bars = words.count("|")
    if bars >= rules.min_bars and bars * rules.words_per_bar >= len(words):
        return True
    if len(words) >= rules.min_shout_words and 2 * line.count("!") >= len(words):
        upper = len(_UPPER.findall(line))
        if 10 * upper >= 9 * (upper + len(_LOWER.findall(line))):
            return True
    if len(words) >= rules.min_stutter_words and 2 * sum(a == b for a, b in zip(words, words[1:])) > len(words):
        return True
    if seen and len(words) >= rules.min_bars:
        return True
    if len(words) <= 12:
        low = line.lower()
        return any(p in low for p in BOILERPLATE)
    return False


def repeated_words(words: list[bytes], window: int) -> int:
    """How many words stand in windows whose word sequence is found twice or more.

    Windows are compared by ranks of doubled length, which are exact: no hashes.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = rank[: len(rank) - step] * (n + 1) + rank[step:]
        _, rank = np.unique(pairs, return_inverse=True)
        length += step
    counts = np.bincount(rank)
    starts = np.flatnonzero(counts[rank] > 1)
    if not len(starts):
        return 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def judge(text: str | None, rules: Rules = Rules()) -> tuple[str, int, int, int, int, int, bool, bool]:
    """cleaned text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of one text."""
    text = text or ""
    raw = words_of(text)
    n = len(raw)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeats = repeated_words(raw, rules.window)
    lines, good, before = text.split("\n"), [], set()
    dup = lost = 0
    for line in lines:
        words = line.translate(_TO_SPACE).split(" ") if line.strip(SPACES) else []
        words = [w for w in words if w]
        if not words:
            good.append(line)
            continue
        seen = line in before
        before.add(line)
        dup += seen
        if line_fails(line, words, seen, rules):
            lost += sum(map(len, words))
        else:
            good.append(line)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not failed and 100 * lost <= rules.max_lost_percent * word_chars
    return "\n".join(good), n, word_chars, symbols, dup, repeats, failed, kept


_TO_SPACE = {ord(c): " " for c in SPACES}


def apply_rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its cleaned text, counts and verdict.

    Columns: doc_id, cleaned_text, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, then those named in `keep`.  A null text
    has no words and fails.  Repeated rows and null ids each give a row; no
    column but those named is read.  One pass without a shuffle.
    """
    bound_batches(df.sparkSession)
    # A column of `keep` comes under a private name, so that it can't clash.
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    kinds = "doc_id long, cleaned_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    kinds += "".join(f", _keep{i} {own.schema[f'_keep{i}'].dataType.simpleString()}" for i in range(len(keep)))
    types = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, rules) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names)
        release_memory()

    return own.mapInArrow(run, kinds)
