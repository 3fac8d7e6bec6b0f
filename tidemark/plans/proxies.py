"""The engine's tables, shaped from the generic test tables; and the same shapes as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schema import PLACEHOLDER

TIERS = ("major", "daily", "online", "wire", "global", "crypto", "unknown", "blog", "community", "pr", "vendor", "algo")
CHANNELS = ("news", "news", "news", "news", "news", "cafe", "news", "cafe", "community", "pr", "vendor", "algo")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def media(spark: SparkSession, d: str) -> DataFrame:
    """Twelve outlets named after nations, a tier each; the unknown one goes by the placeholder's name."""
    names = F.array(*[F.lit(t) for t in TIERS]), F.array(*[F.lit(c) for c in CHANNELS])
    n = table(spark, d, "nation").where("n_nationkey < 12")
    key = F.col("n_nationkey") + 1
    return n.select(
        F.col("n_nationkey").cast("long").alias("media_id"),
        F.when(F.col("n_nationkey") == 6, F.lit(PLACEHOLDER)).otherwise(F.col("n_name")).alias("name"),
        F.concat(F.lit("m"), F.col("n_nationkey"), F.lit(".example.co.kr")).alias("domain"),
        F.element_at(names[0], key).alias("tier"),
        F.element_at(names[1], key).alias("channel"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Events as labelled documents of five codes."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    label = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    known = (i % 7) != 0
    return e.select(
        i.alias("doc_id"),
        F.concat(F.lit("E"), F.col("user_id") % 5).alias("code"),
        (F.col("user_id") % 12).alias("media_id"),
        F.element_at(F.array(F.lit("rss"), F.lit("board"), F.lit("api")), ((i % 3) + 1).cast("int")).alias("source"),
        F.when(i % 97 != 0, F.concat(F.lit("http://www.m"), F.col("user_id") % 12, F.lit(".example.co.kr/article/"), i % 4000, F.lit("/x"))).alias("url"),
        F.concat_ws(" ", "event_type", F.floor(F.col("value") / 10).cast("string")).alias("title"),
        F.when(i % 50 != 0, F.col("user_id").cast("string")).alias("author"),
        F.when(i % 9 != 0, F.floor("value").cast("long")).alias("engagement"),
        F.when(i % 101 != 0, F.col("ts").cast("timestamp")).alias("published_utc"),
        F.when(i % 101 != 0, F.to_date(F.col("ts") + F.expr("INTERVAL 9 HOURS"))).alias("kst_date"),
        F.when(known, label).cast("int").alias("label"),
        F.when(known, (i % 11 != 0).cast("int")).alias("is_relevant"),
        F.when(known, (i % 100) / 100.0).alias("confidence"),
        F.when(known, F.when(i % 13 == 0, "v2").otherwise("v3")).alias("prompt_version"),
        F.when(known, F.when(i % 17 == 0, "inherited").otherwise("stub")).alias("label_model"),
        F.concat(F.lit("g"), i % 300).alias("dup_group_id"),
        (F.floor(i / 300) % 3 != 1).cast("int").alias("is_canonical"),
    )


def sentiment_daily(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a long history of daily label counts of three codes."""
    x = table(spark, d, "lineitem")
    day = F.to_date("l_shipdate")
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    return (
        x.select(
            F.concat(F.lit("L"), F.col("l_suppkey") % 3).alias("code"),
            day.alias("kst_date"),
            F.date_add(day, F.when(F.col("l_linenumber") > 3, 1).otherwise(0)).alias("signal_date"),
            (F.col("l_suppkey") % 12).alias("media_id"),
            "l_returnflag",
            "l_quantity",
        )
        .groupBy("code", "kst_date", "signal_date", "media_id")
        .agg(flag("R").alias("pos"), flag("N").alias("neu"), flag("A").alias("neg"), F.count("*").alias("doc_cnt"), F.count_if(F.col("l_quantity") > 10).alias("canonical_cnt"))
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as daily bars of three codes on weekdays; some opens are missing or zero."""
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    bars = (
        o.where(~F.dayofweek(day).isin(1, 7))
        .groupBy(F.concat(F.lit("L"), F.col("o_custkey") % 3).alias("code"), day.alias("kst_date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count("*").alias("volume"),
        )
    )
    m = F.dayofmonth("kst_date")
    return bars.withColumn("open", F.when(m == 7, F.lit(None)).when(m == 8, F.lit(0.0)).otherwise(F.col("open"))).withColumn("source", F.when(F.year("kst_date") < 1998, "a").otherwise("b"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Events as coverage reports: many a (code, source, date), in two runs."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "empty", "partial", "failed", "pending")]), (i % 5 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("E"), F.col("user_id") % 5).alias("code"),
        F.when(i % 3 == 0, "rss").otherwise("board").alias("source"),
        F.to_date("ts").alias("kst_date"),
        F.when(i % 40 < 5, status).otherwise("completed").alias("status"),
        (i % 30).alias("doc_count"),
        F.when(i % 2 == 0, i.cast("string")).alias("last_cursor"),
        (F.floor(i / F.lit(4)) % 2).alias("run"),
        i.alias("seq"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Eight codes, of which some have documents or prices."""
    return table(spark, d, "nation").where("n_nationkey < 8").select(
        F.when(F.col("n_nationkey") < 5, F.concat(F.lit("E"), F.col("n_nationkey"))).otherwise(F.concat(F.lit("L"), F.col("n_nationkey") - 5)).alias("code"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 3 + 1).alias("priority"),
        (F.col("n_nationkey") != 3).cast("int").alias("is_active"),
    )


def titles(spark: SparkSession, d: str) -> DataFrame:
    """First lines of documents, dated in seven days."""
    x = table(spark, d, "documents")
    return x.select("doc_id", F.lit("T").alias("code"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")).alias("kst_date"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("author"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

CTE = {
    "media": f"SELECT n_nationkey::BIGINT AS media_id, CASE WHEN n_nationkey = 6 THEN '{PLACEHOLDER}' ELSE n_name END AS name, 'm' || n_nationkey || '.example.co.kr' AS domain, ({_list(TIERS)})[n_nationkey + 1] AS tier, ({_list(CHANNELS)})[n_nationkey + 1] AS channel FROM nation WHERE n_nationkey < 12",
    "docs": """SELECT event_id AS doc_id, 'E' || (user_id % 5) AS code, user_id % 12 AS media_id, (['rss', 'board', 'api'])[(event_id % 3) + 1] AS source,
  CASE WHEN event_id % 97 <> 0 THEN 'http://www.m' || (user_id % 12) || '.example.co.kr/article/' || (event_id % 4000) || '/x' END AS url,
  event_type || ' ' || (floor(value / 10)::BIGINT) AS title, CASE WHEN event_id % 50 <> 0 THEN user_id::VARCHAR END AS author,
  CASE WHEN event_id % 9 <> 0 THEN floor(value)::BIGINT END AS engagement, CASE WHEN event_id % 101 <> 0 THEN ts END AS published_utc,
  CASE WHEN event_id % 101 <> 0 THEN (ts + INTERVAL 9 HOUR)::DATE END AS kst_date,
  CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END END AS label,
  CASE WHEN event_id % 7 <> 0 THEN (event_id % 11 <> 0)::INT END AS is_relevant, CASE WHEN event_id % 7 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS confidence,
  CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 13 = 0 THEN 'v2' ELSE 'v3' END END AS prompt_version,
  CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 17 = 0 THEN 'inherited' ELSE 'stub' END END AS label_model,
  'g' || (event_id % 300) AS dup_group_id, ((event_id // 300) % 3 <> 1)::INT AS is_canonical FROM events""",
    "sd": """SELECT 'L' || (l_suppkey % 3) AS code, l_shipdate::DATE AS kst_date, (l_shipdate::DATE + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END)::DATE AS signal_date, l_suppkey % 12 AS media_id,
  count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag = 'N') AS neu, count(*) FILTER (WHERE l_returnflag = 'A') AS neg,
  count(*) AS doc_cnt, count(*) FILTER (WHERE l_quantity > 10) AS canonical_cnt FROM lineitem GROUP BY 1, 2, 3, 4""",
    "prices": """SELECT code, kst_date, CASE WHEN day(kst_date) = 7 THEN NULL WHEN day(kst_date) = 8 THEN 0.0 ELSE open END AS open, high, low, close, volume, CASE WHEN year(kst_date) < 1998 THEN 'a' ELSE 'b' END AS source
  FROM (SELECT 'L' || (o_custkey % 3) AS code, o_orderdate::DATE AS kst_date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
        FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1, 2)""",
    "cov": """SELECT 'E' || (user_id % 5) AS code, CASE WHEN event_id % 3 = 0 THEN 'rss' ELSE 'board' END AS source, ts::DATE AS kst_date,
  CASE WHEN event_id % 40 < 5 THEN (['completed', 'empty', 'partial', 'failed', 'pending'])[(event_id % 5) + 1] ELSE 'completed' END AS status, event_id % 30 AS doc_count,
  CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS last_cursor, (event_id // 4) % 2 AS run, event_id AS seq FROM events""",
    "entities": "SELECT CASE WHEN n_nationkey < 5 THEN 'E' || n_nationkey ELSE 'L' || (n_nationkey - 5) END AS code, n_name AS name, n_nationkey % 3 + 1 AS priority, (n_nationkey <> 3)::INT AS is_active FROM nation WHERE n_nationkey < 8",
    "titles": "SELECT doc_id, 'T' AS code, (DATE '2024-01-01' + (doc_id % 7)::INT)::DATE AS kst_date, split_part(text, chr(10), 1) AS title, source AS author FROM documents",
    "weights": "SELECT * FROM (VALUES ('major', 5.0::DOUBLE), ('daily', 2.0), ('online', 1.0), ('wire', 4.0), ('global', 2.0), ('crypto', 1.0), ('unknown', 1.0), ('blog', 0.05), ('aggregator', 0.0), ('vendor', 0.0), ('algo', 0.0), ('pr', 0.0), ('community', 0.0)) w(tier, weight)",
}


def with_(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named common table expressions in front."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({CTE[n]})" for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")


def plain(x: Column) -> Column:
    """Without negative zeros, which compare equal but hash apart."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def plain_sql(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE {x} END"


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")
