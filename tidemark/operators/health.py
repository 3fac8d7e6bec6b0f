"""Data-quality checks, each a one-row table (name, level, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import REPLACEMENT
from tidemark.operators.ledger import label_coverage
from tidemark.schema import MIN_LABELED_RATIO, NON_OPINION_CHANNELS

OK, WARN, FAIL = "OK", "WARN", "FAIL"


def _row(df: DataFrame, name: str, n: Column, warn: Column | None = None, fail: Column | None = None) -> DataFrame:
    level = F.lit(OK) if warn is None else F.when(warn, WARN).otherwise(OK)
    if fail is not None:
        level = F.when(fail, FAIL).otherwise(level)
    return df.select(F.lit(name).alias("name"), level.alias("level"), n.cast("long").alias("n"))


def utc(stamps: DataFrame) -> DataFrame:
    x = stamps.agg(F.count_if(~F.col("stamp").like("%+00:00")).alias("n"))
    return _row(x, "utc", F.col("n"), fail=F.col("n") > 0)


def encoding(docs: DataFrame) -> DataFrame:
    x = docs.agg(F.count_if(F.contains("title", F.lit(REPLACEMENT))).alias("n"))
    return _row(x, "encoding", F.col("n"), fail=F.col("n") > 0)


def prompts(docs: DataFrame) -> DataFrame:
    x = docs.where("label_model <> 'inherited'").agg(F.countDistinct("prompt_version").alias("n"))
    return _row(x, "prompt", F.col("n"), warn=F.col("n") > 1)


def unknown_outlets(docs: DataFrame, media: DataFrame) -> DataFrame:
    """Documents of unknown outlets in the news channel, and whether they are a fifth of it."""
    x = docs.join(media.where("channel = 'news'").select("media_id", "tier"), "media_id").agg(F.count_if(F.col("tier") == "unknown").alias("n"), F.count("*").alias("total"))
    return _row(x, "unknown", F.col("n"), warn=F.coalesce(F.col("n") * 5 >= F.col("total"), F.lit(False)) & (F.col("total") > 0))


def consistency(docs: DataFrame, sd: DataFrame, entities: DataFrame) -> DataFrame:
    """(code, docs, counted) of active codes whose dated documents and aggregate disagree."""
    a = docs.where("kst_date IS NOT NULL AND published_utc IS NOT NULL").groupBy("code").agg(F.count("*").alias("docs"))
    b = sd.groupBy("code").agg(F.sum("doc_cnt").alias("counted"))
    x = entities.where("is_active = 1").select("code").join(a, "code", "left").join(b, "code", "left")
    x = x.select("code", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return x.where("docs <> counted")


def no_prices(entities: DataFrame, prices: DataFrame) -> DataFrame:
    """Active codes of priority 2 or better without any price."""
    return entities.where("is_active = 1 AND priority <= 2").join(prices.select("code").distinct(), "code", "left_anti").select("code")


def stale(entities: DataFrame, ledger: DataFrame, today: Column) -> DataFrame:
    """(code, age, level) of active codes of priority 2 or better: days since the last report; 999 if there was none."""
    last = ledger.groupBy("code").agg(F.max("kst_date").alias("last"))
    age = F.coalesce(F.datediff(today, "last"), F.lit(999))
    return entities.where("is_active = 1 AND priority <= 2").join(last, "code", "left").select("code", age.alias("age"), F.when(age >= 5, FAIL).when(age >= 3, WARN).otherwise(OK).alias("level"))


def backlog(docs: DataFrame, media: DataFrame, most: int = 5000) -> DataFrame:
    opinion = media.where(~F.col("channel").isin(*NON_OPINION_CHANNELS)).select("media_id")
    x = docs.where("label IS NULL AND is_canonical = 1").join(opinion, "media_id").agg(F.count("*").alias("n"))
    return _row(x, "pending", F.col("n"), warn=F.col("n") >= most)


def source_jumps(prices: DataFrame, warn: float = 0.15, fail: float = 0.30) -> DataFrame:
    """(code, kst_date, jump, level): returns across a change of source that are too large."""
    w = Window.partitionBy("code").orderBy("kst_date")
    x = prices.withColumns({"was": F.lag("source").over(w), "before": F.lag("close").over(w)}).where("source <> was")
    jump = F.abs(F.try_divide(F.col("close"), F.col("before")) - 1)
    return x.select("code", "kst_date", jump.alias("jump"), F.when(jump >= fail, FAIL).when(jump >= warn, WARN).otherwise(OK).alias("level"))


def low_coverage(docs: DataFrame, media: DataFrame, least: int = 500) -> DataFrame:
    return label_coverage(docs, media).where((F.col("ratio") < MIN_LABELED_RATIO) & (F.col("canonical") >= least))


def incomplete(ledger: DataFrame, least: int = 30, share: float = 0.20) -> DataFrame:
    """(code, source, total, ratio, level) of sources with enough days."""
    bad = F.count_if(F.col("status").isin("partial", "failed"))
    total = F.count_if(F.col("status").isin("partial", "failed", "completed", "empty"))
    x = ledger.groupBy("code", "source").agg(total.alias("total"), bad.alias("bad")).where(F.col("total") >= least)
    ratio = F.col("bad") / F.col("total")
    return x.select("code", "source", "total", ratio.alias("ratio"), F.when(ratio >= share, WARN).otherwise(OK).alias("level"))


def counted(df: DataFrame, name: str, level: str = WARN) -> DataFrame:
    """A check that holds as long as ``df`` is empty."""
    x = df.agg(F.count("*").alias("n"))
    bad = F.col("n") > 0
    return _row(x, name, F.col("n"), warn=bad if level == WARN else None, fail=bad if level == FAIL else None)


def worst(df: DataFrame, name: str) -> DataFrame:
    """A check as bad as the worst ``level`` in ``df``; n counts rows that are not OK."""
    x = df.agg(F.count_if(F.col("level") == FAIL).alias("f"), F.count_if(F.col("level") == WARN).alias("w"))
    return _row(x, name, F.col("f") + F.col("w"), warn=F.col("w") > 0, fail=F.col("f") > 0)


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def exit_code(checks: DataFrame) -> DataFrame:
    """0 if all hold, 1 with warnings, 2 with failures."""
    return checks.agg(F.coalesce(F.max(F.when(F.col("level") == FAIL, 2).when(F.col("level") == WARN, 1).otherwise(0)), F.lit(0)).alias("exit_code"))
