"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words and word pairs in BUCKETS buckets) are counted from the target text and
from all text; a document's weight is the log ratio of their probabilities, and Gumbel top-k on the weights draws a
sample without replacement in proportion to them.  Target text is that of labelled rows with quality 1 that are not
toxic.  Counts are vectors of fixed length, summed by worker before they meet; the k-th largest key is found from
histograms and then exactly inside one narrow bin, so no global sort is needed.

Defined cases: null or empty text has no n-grams and weight 0; a null doc_id gets the noise of id 0; repeated rows get
equal keys, ties at the cut all stay; without target rows all weights are 0 and the draw is uniform; an empty table
gives an empty result; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import words as W
from tidemark.llm.store import Scratch, lean, small

BUCKETS = 1 << 14
SMOOTH = 1.0
#: Share of the rows that is drawn.
SHARE = 0.5
BINS = 1 << 12
FEW = 2000
#: Labelled rows that the target model is counted from, at most about (taken by hash); the model of all text has no bound.
TARGET_ROWS = 200_000
U = np.uint64


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word and pair, pointers by row)."""
    h, ptr = W.word_hashes(data, off)
    n = np.diff(ptr)
    sizes = np.maximum(2 * n - 1, 0)
    at = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(h)) - ptr[:-1][row]
    out = np.zeros(at[-1], np.int32)
    shift = U(64 - BUCKETS.bit_length() + 1)
    out[at[:-1][row] + nth] = (W.mix(h, 5) >> shift).astype(np.int32)
    later = np.flatnonzero(nth > 0)
    out[at[:-1][row[later]] + n[row[later]] + nth[later] - 1] = (W.mix(h[later - 1] * U(3) ^ h[later], 6) >> shift).astype(np.int32)
    return out, at


def _counts(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, off in W.chunks(batch.column(0)):
                total += np.bincount(buckets(data, off)[0], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for row in docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_grams, weight (sum of log ratios) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(_counts(target), _counts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in W.chunks(batch.column(1)):
                b, ptr = buckets(data, off)
                sums = np.concatenate([[0.0], np.cumsum(shared.value[b])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ptr).astype(np.int64)), pa.array(sums[ptr[1:]] - sums[ptr[:-1]])], names=["doc_id", "n_grams", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_grams long, weight double")


def gumbel_top(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Adds ``gumbel_key`` and ``selected``: the share of rows with the largest keys."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "quality")
    even = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(17)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scratch.save(rows.withColumn("gumbel_key", F.col("weight") - F.log(-F.log(even))), "keyed")
    bounds = keyed.agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).first()
    k = int(round(bounds["n"] * share))
    if not k:
        return keyed.withColumn("selected", F.lit(False))
    above, inside = 0, keyed.select("gumbel_key")
    lo, hi, held = bounds["lo"], bounds["hi"], bounds["n"]
    # narrow the bin that holds the k-th key until few keys are left in it, or all are equal
    while held > FEW and hi > lo:
        step = (hi - lo) / BINS
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("gumbel_key") - lo) / step)).cast("int")
        bins = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()  # BINS rows at most
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        lo, hi, held = row["lo"], row["hi"], row["n"]
        inside = inside.where(F.col("gumbel_key").between(lo, hi))
    inside = inside.groupBy("gumbel_key").agg(F.count("*").alias("n"))
    upto = inside.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("gumbel_key").desc())))  # at most FEW keys
    cut = upto.where(F.col("upto") >= k - above).agg(F.max("gumbel_key")).first()[0]
    return keyed.withColumn("selected", F.col("gumbel_key") >= cut)


def select(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_grams, weight, gumbel_key, selected: one row for each row of ``docs``."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = good.count()
    if n > TARGET_ROWS:
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * TARGET_ROWS / n))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return gumbel_top(weights(read, read.join(small(good, min(n, 2 * TARGET_ROWS), 16), "doc_id", "left_semi")), share)
