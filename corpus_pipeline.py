"""A corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``.  Null text has no language and goes in the first stage; empty tables pass through; extra columns are
kept until packing, whatever their names.  Decisions are made for rows, not ids: rows without an id, or with one that
others bear, stay or go by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, neardup, packing, pii
from tidemark.llm.store import Scratch, small_batches, swept, table


#: Near-duplicates: words of a shingle, and the similarity of 100 from which documents count as copies.
SHINGLE, LEAST = 5, 80
#: Bytes of words that a packing worker remembers: less than in a packing job of its own, as executors come to it filled.
WORDS_BYTES = 16 << 20
#: For the same reason: bytes of an Arrow batch, where the session sets none, and stretches that language ID reads together.
BATCH_BYTES, TOGETHER = 2 << 20, 256


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _without(spark: SparkSession, docs: DataFrame, name: str, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose numbers ``gone`` gives, from a table (doc_id, text) with the rows' numbers as ids."""
    scratch, key = Scratch(spark, name), _free(docs, "row")
    numbered = scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    with swept(spark):
        rows = scratch.save(gone(numbered.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key)), "gone")
    return numbered.join(rows, key, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; those without letters go."""
    small_batches(spark, BATCH_BYTES)
    names, found = docs.columns, (_free(docs, "lang_pred"), _free(docs, "score"))
    out = langid.predict(docs, langid.train(docs), keep=names, names=found, together=TOGETHER)
    return out.where(F.col(found[0]) != langid.UND).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the first in the table's order; rows without words are in no group."""
    return _without(spark, docs, "pipeline-copies", lambda rows: neardup.cluster(rows, SHINGLE, LEAST).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of which a twentieth of the words or more is in a benchmark window."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _without(spark, docs, "pipeline-benchmark", lambda rows: decontam.verdicts(rows, benchmark).where("contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; the character count follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cache_bytes=WORDS_BYTES)


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

#: Language ID is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
