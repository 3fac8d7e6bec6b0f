"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in order of (doc_id, checksum), sizes are summed by range partition, the totals' prefix sums give each
partition its base, and a row's shard is the target interval in which the middle of its bytes falls.  The text itself
is never moved: only ids, sizes and checksums are.  Everything is DataFrame functions.

Null text counts as no bytes; a null doc_id sorts first; rows that repeat are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Scratch

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = scratch.save(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "sized")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "text_crc32", "row"]
    dealt = scratch.save(sized.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "dealt")

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each shuffle partition, so this window's single task is bounded by their number.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row_base"), F.sum("bytes").over(every).alias("total"))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"upto": F.sum("size").over(within), "nth": F.count("*").over(within)}).join(F.broadcast(bases), "part")
    middle = F.col("base") + F.col("upto") - F.expr("size div 2")
    shard = F.least(F.lit(shards - 1), F.floor(middle / (F.col("total") / F.lit(shards)))).cast("int")
    placed = scratch.save(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row_base") + F.col("nth") - 1).alias("rank")), "placed")
    scratch.drop("sized", "dealt")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
