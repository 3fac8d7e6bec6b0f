"""Duplicates within a code and day: equal titles, close titles, and authors who post too much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import bands, blocking_key, hamming, indel_ratio, simhash64, title_hash
from tidemark.schema import AUTHOR_DAILY_CAP, BUCKET_LIMIT, FUZZY_SCORE, SIMHASH_DISTANCE

DAY = ["code", "kst_date"]


def exact(docs: DataFrame) -> DataFrame:
    """doc_id, dup_group_id, is_canonical of titles that occur more than once; the smallest id stays canonical."""
    w = Window.partitionBy(*DAY, "title_hash")
    x = docs.withColumns({"n": F.count("*").over(w), "first": F.min("doc_id").over(w)}).where("n > 1")
    return x.select("doc_id", F.left("title_hash", F.lit(12)).alias("dup_group_id"), (F.col("doc_id") == F.col("first")).cast("int").alias("is_canonical"))


def spam(docs: DataFrame, cap: int = AUTHOR_DAILY_CAP) -> DataFrame:
    """doc_id of an author's documents beyond the first ``cap`` of a day; no author, no cap."""
    known = docs.where("author IS NOT NULL AND author <> ''")
    return known.withColumn("_rn", F.row_number().over(Window.partitionBy(*DAY, "author").orderBy("doc_id"))).where(F.col("_rn") > cap).select("doc_id")


def candidate_pairs(docs: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs that share a prefix or a part of the simhash, from buckets of 2 to ``limit`` documents; larger ones are passed over."""
    prefix = docs.select(*DAY, "doc_id", F.concat(F.lit("p"), blocking_key(F.col("norm"))).alias("bucket")).where("bucket <> 'p'")
    parts = F.posexplode(bands(F.col("simhash")))
    banded = docs.where("simhash <> 0").select(*DAY, "doc_id", parts.alias("k", "v")).select(*DAY, "doc_id", F.concat_ws(":", F.lit("b"), "k", "v").alias("bucket"))
    every = prefix.union(banded)
    sizes = every.groupBy(*DAY, "bucket").agg(F.count("*").alias("n")).where(F.col("n").between(2, limit)).drop("n")
    held = every.join(sizes, [*DAY, "bucket"])
    a, b = held.withColumnRenamed("doc_id", "a"), held.withColumnRenamed("doc_id", "b")
    return a.join(b, [*DAY, "bucket"]).where("a < b").select(*DAY, "a", "b").distinct()


def near_edges(docs: DataFrame, distance: int = SIMHASH_DISTANCE, score: float = FUZZY_SCORE) -> DataFrame:
    """(code, kst_date, a, b): titles close in simhash and in wording, and chains of equal ones."""
    first = F.min("doc_id").over(Window.partitionBy(*DAY, "title_hash"))
    equal = docs.select(*DAY, first.alias("a"), F.col("doc_id").alias("b")).where("a < b")
    side = lambda x: docs.select(*DAY, F.col("doc_id").alias(x), F.col("norm").alias(f"n{x}"), F.col("simhash").alias(f"s{x}"))
    pairs = candidate_pairs(docs).join(side("a"), [*DAY, "a"]).join(side("b"), [*DAY, "b"])
    close = pairs.where((F.col("sa") == 0) | (F.col("sb") == 0) | (hamming(F.col("sa"), F.col("sb")) <= distance))
    # lengths bound the score from above, so most pairs need no UDF
    short, long = F.least(F.length("na"), F.length("nb")), F.greatest(F.length("na"), F.length("nb"))
    close = close.where(200.0 * short >= score * (short + long)).where(indel_ratio("na", "nb") >= score)
    return equal.union(close.select(*DAY, "a", "b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(code, kst_date, doc_id, root): smallest id reachable, by repeated minimum over neighbours with checkpoints."""
    both = edges.union(edges.select(*DAY, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    spark = edges.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    both = both.checkpoint()
    state = both.groupBy(*DAY, F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    for _ in range(rounds):
        low = both.join(state.withColumnRenamed("doc_id", "b"), [*DAY, "b"]).groupBy(*DAY, F.col("a").alias("doc_id")).agg(F.min("root").alias("low"))
        stepped = state.join(low, [*DAY, "doc_id"]).select(*DAY, "doc_id", F.least("root", "low").alias("root"))
        # jump to the root's own root, so long chains take few rounds
        roots = stepped.select(*DAY, F.col("doc_id").alias("root"), F.col("root").alias("up"))
        jumped = stepped.join(roots, [*DAY, "root"], "left").select(*DAY, "doc_id", F.least("root", F.coalesce("up", "root")).alias("root")).checkpoint()
        moved = jumped.join(state.withColumnRenamed("root", "was"), [*DAY, "doc_id"]).where("root <> was").isEmpty()
        state = jumped
        if moved:
            return state
    raise RuntimeError(f"the groups were not complete after {rounds} rounds")


def near_dedup(docs: DataFrame, author_cap: int = AUTHOR_DAILY_CAP) -> DataFrame:
    """doc_id, dup_group_id, is_canonical; ``docs`` has code, kst_date, doc_id, norm, author."""
    x = docs.withColumns({"title_hash": title_hash(F.col("norm")), "simhash": simhash64(F.col("norm"))})
    roots = components(near_edges(x))
    out = x.select(*DAY, "doc_id").join(roots, [*DAY, "doc_id"], "left").join(spam(docs, author_cap).withColumn("is_spam", F.lit(True)), "doc_id", "left")
    lone = F.col("root").isNull()
    return out.select("doc_id", F.when(~lone, F.concat(F.lit("g"), "root")).alias("dup_group_id"), ((lone | (F.col("root") == F.col("doc_id"))) & F.col("is_spam").isNull()).cast("int").alias("is_canonical"))
