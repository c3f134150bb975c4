"""The corpus pipeline: documents to token ids in five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again before
the next stage, so that a lost executor costs one stage at most and no stage recomputes another.

Defined results, for every stage: a null text counts as empty; a null doc_id, lang, source or n_chars is kept as it is;
columns that a stage does not know are carried along, whatever their names; an empty table gives an empty one. Texts are
read whole. What becomes of repeated rows, ties and rows without a doc_id is said below; tests/llm/test_pipeline.py holds
each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import bpe_codec, decontamination, jaccard_join, quality_rules, suffix_dedup
from rasterloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the current policy of the quality rules. An empty text has too few words and goes; repeated rows
    are judged alike and stay as often."""
    return quality_rules.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id. Of repeated rows one stays, of rows that
    share a doc_id one for each set of shingles; a row without doc_id goes if its group has one with an id, and of a group
    without any id one row stays."""
    return jaccard_join.stage(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of 100-byte strings that start earlier in the corpus (smaller doc_id, none last; or the same document);
    what is left of a cut character goes too, and n_chars follows the text. No row goes, even if its text becomes empty;
    repeated rows are one document and change alike."""
    return suffix_dedup.stage(spark, docs, sf_dir)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. An empty text holds none and stays; repeated rows go or stay alike."""
    return decontamination.stage(spark, docs, sf_dir)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, n_tokens, the ids, and digests of the ids and of their decoding. An empty text has no ids;
    repeated rows give repeated rows."""
    return bpe_codec.stage(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("bpe_encoding", token_ids),
]

#: SQL cannot state the suffix and token stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
