"""Incremental ingest with Structured Streaming: the batch operators run on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.finance import signal_date
from tidemark.operators.ledger import aggregate_sentiment, insert_documents


def read_documents(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    """Documents as files arrive; at most ``most_files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def first_seen(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """One row for each (code, source, url); state is dropped after ``late``.  Rows without an address all stay."""
    timed = stream.withWatermark("published_utc", late)
    return timed.where("url IS NOT NULL").dropDuplicatesWithinWatermark(["code", "source", "url"]).union(timed.where("url IS NULL"))


def live_counts(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Label counts in windows of event time, final once ``late`` has passed."""
    return (
        stream.withWatermark("published_utc", late)
        .groupBy(F.window("published_utc", width).alias("w"), "code")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == -1).alias("neg"), F.count("*").alias("docs"))
        .select("code", F.col("w.start").alias("start"), "pos", "neg", "docs")
    )


#: Folders over which a code's known addresses are spread; a batch reads only those that its own addresses fall into.
ADDRESS_FOLDERS = 64


def ingest(stream: DataFrame, docs_path: str, daily_path: str, checkpoint: str, undated_path: str | None = None) -> StreamingQuery:
    """Append new documents, then write again the daily counts they touch; runs over what has arrived and stops.

    Documents lie in folders of (code, kst_date), so a batch reads and overwrites only its own days.  An address is known
    whatever day it came on: addresses lie beside the documents in folders by their hash.  Rows that are known by id or
    address are not appended again, and addresses follow their documents, so a batch that is run twice leaves the same
    tables.  Rows without a date go to ``undated_path``, if that is given.
    """
    known_path = f"{docs_path.rstrip('/')}_addresses"

    def batch(rows: DataFrame, number: int) -> None:
        spark, columns = rows.sparkSession, rows.columns
        if undated_path:
            rows.where("kst_date IS NULL").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(undated_path)
        rows = rows.where("kst_date IS NOT NULL")
        days = rows.select("code", "kst_date").distinct().persist()
        rows.limit(0).write.mode("append").partitionBy("code", "kst_date").parquet(docs_path)
        folder = F.pmod(F.xxhash64("code", "source", "url"), F.lit(ADDRESS_FOLDERS)).cast("int")
        address = lambda x: x.where("url IS NOT NULL").select("source", "url", "code", folder.alias("folder"))
        address(rows).limit(0).write.mode("append").partitionBy("code", "folder").parquet(known_path)

        def of_days() -> DataFrame:
            return spark.read.schema(rows.schema).parquet(docs_path).join(days, ["code", "kst_date"], "left_semi").select(*columns)

        asked = address(rows).select("code", "folder").distinct()
        known = spark.read.schema(address(rows).schema).parquet(known_path).join(asked, ["code", "folder"], "left_semi")
        new = insert_documents(rows, known).join(of_days().select("doc_id"), "doc_id", "left_anti")
        new.select(*columns).write.mode("append").partitionBy("code", "kst_date").parquet(docs_path)
        kept = of_days().join(rows.select("doc_id"), "doc_id", "left_semi")
        address(kept).distinct().join(known, ["code", "folder", "source", "url"], "left_anti").select("source", "url", "code", "folder").write.mode("append").partitionBy("code", "folder").parquet(known_path)
        aggregate_sentiment(of_days()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code", "kst_date").parquet(daily_path)
        days.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_signal_date(stream: DataFrame) -> DataFrame:
    """Event time decides the signal's day, however late a row comes; rows without a time are left out."""
    return stream.where("published_utc IS NOT NULL").withColumn("signal_date", signal_date(F.col("published_utc")))
