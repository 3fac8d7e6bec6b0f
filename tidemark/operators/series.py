"""Price and sentiment series: ranges, bins, heat, gaps and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.finance import bin_end, polarity

DAYS = {"3m": 90, "6m": 180, "1y": 365}


def clip_range(prices: DataFrame, sentiment: DataFrame, rng: str) -> DataFrame:
    """Prices in a chart's range: the sentiment's days and a margin, or so many days up to the last price."""
    if rng == "all":
        return prices
    if rng == "data":
        bounds = sentiment.groupBy("code").agg(F.date_sub(F.min("kst_date"), 10).alias("lo"), F.date_add(F.max("kst_date"), 5).alias("hi"))
    else:
        bounds = prices.groupBy("code").agg(F.date_sub(F.max("kst_date"), DAYS[rng]).alias("lo"), F.max("kst_date").alias("hi"))
    return prices.join(bounds, "code").where("kst_date BETWEEN lo AND hi").drop("lo", "hi")


def resample_ohlc(prices: DataFrame, freq: str) -> DataFrame:
    """Bars of a week (to Friday) or month; bins without a close are dropped."""
    d = F.col("kst_date")
    some = lambda agg, c: agg(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), d))
    bars = prices.groupBy("code", bin_end(d, freq).alias("bin")).agg(
        some(F.min_by, "open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), some(F.max_by, "close").alias("close"), F.sum("volume").alias("volume")
    )
    return bars.where("close IS NOT NULL")


def _bins(df: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """Every bin between each key's first and last."""
    span = df.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    step = {"daily": F.expr("INTERVAL 1 DAY"), "weekly": F.expr("INTERVAL 7 DAYS"), "W": F.expr("INTERVAL 7 DAYS")}
    if freq in step:
        every = F.sequence("lo", "hi", step[freq])
    else:
        months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))
        every = F.transform(months, lambda m: F.last_day(m))
    return span.select(*keys, F.explode(every).alias("bin"))


def resample_sum(df: DataFrame, keys: list[str], values: list[str], freq: str, day: str = "kst_date") -> DataFrame:
    """Sums by bin; empty bins inside a key's range are there with 0."""
    got = df.groupBy(*keys, bin_end(F.col(day), freq).alias("bin")).agg(*[F.sum(v).alias(v) for v in values])
    return _bins(got, keys, freq).join(got, [*keys, "bin"], "left").fillna(0, subset=values)


def resample_mean(df: DataFrame, keys: list[str], value: str, freq: str, day: str) -> DataFrame:
    """Means by bin without nulls; empty bins inside the range are null."""
    got = df.groupBy(*keys, bin_end(F.col(day), freq).alias("bin")).agg(F.avg(value).alias(value))
    return _bins(got, keys, freq).join(got, [*keys, "bin"], "left")


def heat(count: Column, over: Window) -> Column:
    """Z-score of log volume over a whole series; 0 where volume does not vary."""
    v = F.log1p(count)
    sd = F.stddev_pop(v).over(over)
    return F.when(sd > 1e-12, (v - F.avg(v).over(over)) / sd).otherwise(0.0)


def sentiment_series(sd: DataFrame, media: DataFrame, freq: str = "daily", by: str = "total", media_ids: list[int] | None = None) -> DataFrame:
    """Label counts and polarity by bin, for a code as a whole (with heat) or by tier or outlet.

    Days without documents are not in a daily series; weeks and months between the first and the last are, with 0.  Tiers
    and outlets have the bins of the whole, with 0 where they have no documents.
    """
    values = ["pos", "neu", "neg", "doc_cnt"]
    sd = sd.join(media.select("media_id", "name", "tier"), "media_id")
    if by == "media" and media_ids:
        sd = sd.where(F.col("media_id").isin(media_ids))

    def sums(keys: list[str]) -> DataFrame:
        return sd.groupBy(*keys, bin_end(F.col("kst_date"), freq).alias("bin")).agg(*[F.sum(v).alias(v) for v in values])

    whole = sums(["code"]) if freq == "daily" else resample_sum(sd, ["code"], values, freq)
    if by == "total":
        out = whole.withColumn("heat", heat(F.col("doc_cnt"), Window.partitionBy("code")))
    else:
        keys = ["code", {"tier": "tier", "media": "name"}[by]]
        got = sums(keys)
        out = whole.select("code", "bin").join(got.select(*keys).distinct(), "code").join(got, [*keys, "bin"], "left").fillna(0, subset=values)
    return out.withColumn("polarity", polarity(F.col("pos"), F.col("neg")))


def coverage_gaps(prices: DataFrame, sd: DataFrame) -> DataFrame:
    """Runs of price days without sentiment: from the first bare day to the first covered one, or the last price day."""
    days = prices.select("code", "kst_date").join(sd.select("code", "kst_date").distinct().withColumn("has", F.lit(1)), ["code", "kst_date"], "left")
    w = Window.partitionBy("code").orderBy("kst_date")
    x = days.withColumn("island", F.sum(F.coalesce("has", F.lit(0))).over(w)).withColumn("next_day", F.lead("kst_date").over(w))
    runs = x.where("has IS NULL").groupBy("code", "island").agg(F.min("kst_date").alias("gap_start"), F.max_by("next_day", "kst_date").alias("after"), F.max("kst_date").alias("last"), F.count("*").alias("days"))
    return runs.select("code", "gap_start", F.coalesce("after", "last").alias("gap_end"), "days")


def contiguous_runs(days: DataFrame, keys: list[str], day: str = "kst_date") -> DataFrame:
    """Consecutive dates folded into runs."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    return days.select(*keys, day).distinct().withColumn("anchor", F.date_sub(day, n)).groupBy(*keys, "anchor").agg(F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count("*").alias("days")).drop("anchor")


def missing_dates(calendar: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Days of each key's range (lo, hi) that are not done."""
    every = calendar.select(*keys, F.explode(F.sequence("lo", "hi")).alias("kst_date"))
    return every.join(done.select(*keys, "kst_date").distinct(), [*keys, "kst_date"], "left_anti")


def media_catalog(sd: DataFrame, media: DataFrame, limit: int = 60) -> DataFrame:
    """The outlets with most documents, and how many."""
    n = sd.groupBy("code", "media_id").agg(F.sum("doc_cnt").alias("docs"))
    ranked = n.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.col("docs").desc(), "media_id"))).where(F.col("rn") <= limit)
    return ranked.join(media.select("media_id", "name", "tier"), "media_id").select("code", "media_id", "name", "tier", "docs")


def moving_average(value: Column, over: Window, rows: int = 20, least: int = 10) -> Column:
    """Trailing mean over ``rows`` rows; null unless ``least`` of them have values."""
    w = over.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))
