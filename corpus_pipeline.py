"""The corpus pipeline: stages over documents, each one written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import byte_bpe, decontamination, pii, quality_rules, shingle_dedup, simhash_dedup
from heliograph.llm.common import documents, materialize


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _shaped(out: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs` again: its other columns come as _keep0, _keep1 and so on; n_chars follows the new text."""
    kept = {c: F.col(f"_keep{i}") for i, c in enumerate(_others(docs))}
    new = {"doc_id": F.col("doc_id"), "text": F.col(text)} | kept
    if "n_chars" in kept:
        new["n_chars"] = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return out.select(*(new[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines."""
    judged = quality_rules.apply_rules(docs, keep=_others(docs)).where("kept")
    return _shaped(judged, docs, "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of similarity 0.8 or more."""
    return simhash_dedup.one_of_each(docs, groups=shingle_dedup.near_duplicates(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with labels in place of personal data."""
    found = pii.find_spans(docs, keep=_others(docs))
    return _shaped(found.withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))), docs, "clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids; its text is what the ids decode to."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rest = _others(docs)
    back = byte_bpe.encode(docs, ranks, pattern, decoded=True, keep=rest)
    names = {"doc_id": "doc_id", "text": "decoded"} | {c: f"_keep{i}" for i, c in enumerate(rest)}
    return back.select(*(F.col(names[c]).cast("string" if c == "text" else docs.schema[c].dataType).alias(c) for c in docs.columns), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]
#: The stage for personal data learns from its input, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
