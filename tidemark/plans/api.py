"""What a serving layer asks for: one function for each endpoint and command."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.finance import parse_weights
from tidemark.operators import backtest as bt
from tidemark.operators import series, stats
from tidemark.schema import FEES, NO_FEES, TIER_WEIGHTS


def stocks(entities: DataFrame, sd: DataFrame) -> DataFrame:
    """Codes that have documents, with days, documents and range, most documents first."""
    x = sd.groupBy("code").agg(F.countDistinct("kst_date").alias("days"), F.sum("doc_cnt").alias("docs"), F.min("kst_date").alias("first_day"), F.max("kst_date").alias("last_day"))
    return entities.select("code", "name").join(x.where("docs > 0"), "code").orderBy(F.col("docs").desc(), "code")


def tiers(sd: DataFrame, media: DataFrame) -> DataFrame:
    """Every tier with its weight and documents."""
    spark = sd.sparkSession
    every = spark.createDataFrame(list(TIER_WEIGHTS.items()), "tier string, weight double")
    n = sd.groupBy("media_id").agg(F.sum("doc_cnt").alias("n")).join(media.select("media_id", "tier"), "media_id").groupBy("tier").agg(F.sum("n").alias("docs"))
    return every.join(n, "tier", "left").select("tier", "weight", F.coalesce("docs", F.lit(0)).alias("docs"))


def mapping_progress(sd: DataFrame, media: DataFrame) -> DataFrame:
    """How much of the news channel comes from outlets without a tier."""
    news = media.where("channel = 'news'")
    unknown = F.sum(F.when(F.col("tier") == "unknown", F.col("doc_cnt")))
    docs = sd.join(news.select("media_id", "tier"), "media_id").agg(unknown.alias("unknown_docs"), F.sum("doc_cnt").alias("total_docs"), F.round(100.0 * unknown / F.sum("doc_cnt"), 1).alias("unknown_pct"))
    outlets = news.agg(F.count_if(F.col("tier") != "unknown").alias("mapped"), F.count("*").alias("outlets"))
    return docs.crossJoin(outlets)  # one row each


def chart(prices: DataFrame, sd: DataFrame, media: DataFrame, code: str, freq: str = "daily", by: str = "total", rng: str = "data", media_ids: list[int] | None = None) -> dict[str, DataFrame]:
    """Prices, sentiment, gaps and outlets of one code."""
    if freq not in ("daily", "weekly", "monthly") or by not in ("total", "tier", "media") or rng not in ("data", "3m", "6m", "1y", "all"):
        raise ValueError("unknown frequency, grouping or range")
    p, s = prices.where(F.col("code") == code), sd.where(F.col("code") == code)
    clipped = series.clip_range(p, s, rng)
    return {
        "prices": clipped if freq == "daily" else series.resample_ohlc(clipped, freq),
        "sentiment": series.sentiment_series(s, media, freq, by, media_ids),
        "gaps": series.coverage_gaps(p, s),
        "media": series.media_catalog(s, media),
    }


def backtest(prices: DataFrame, sd: DataFrame, media: DataFrame, code: str, direction: str = "forward", limit: str = "long_only", fees: bool = True, weights: str | None = None) -> dict[str, DataFrame]:
    """A strategy's path, summary and imbalance warnings; empty where the code has no prices or no signal."""
    if direction not in ("forward", "contrarian") or limit not in ("long_only", "unlimited"):
        raise ValueError("unknown direction or limit")
    p, s = prices.where(F.col("code") == code), sd.where(F.col("code") == code)
    charged = FEES if fees else NO_FEES
    path = bt.backtest(p, s, media, parse_weights(weights), direction, limit, charged)
    return {"path": bt.drawdown(bt.rounded(path)), "summary": bt.summary(path, charged), "imbalance": bt.imbalance(bt.assign_trading_day(bt.tier_signal(s, media), p))}


def cross_market(prices: DataFrame, sd: DataFrame, codes: list[str] | None = None, max_lag: int = 5, coverage: DataFrame | None = None) -> DataFrame:
    if not 1 <= max_lag <= 15:
        raise ValueError("max_lag must be 1 to 15")
    if codes:
        prices, sd = prices.where(F.col("code").isin(codes)), sd.where(F.col("code").isin(codes))
    return stats.compare(stats.entity_frame(sd, prices), max_lag, coverage)


def sentiment_matrix(prices: DataFrame, sd: DataFrame, codes: list[str] | None = None, freq: str = "W") -> DataFrame:
    if freq not in ("W", "ME"):
        raise ValueError("freq must be W or ME")
    if codes:
        prices, sd = prices.where(F.col("code").isin(codes)), sd.where(F.col("code").isin(codes))
    return stats.matrix(stats.entity_frame(sd, prices), freq)
