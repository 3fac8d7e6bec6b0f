"""How sentiment and returns move together: lead and lag, comovement, baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.finance import polarity, safe_corr, significance
from tidemark.operators.series import resample_mean
from tidemark.schema import MIN_DAYS, MIN_LABELED_RATIO


def by_day() -> WindowSpec:
    return Window.partitionBy("code").orderBy("kst_date")


def returns(prices: DataFrame) -> DataFrame:
    """Adds ``ret``, the change from the last known close; the first is null."""
    filled = F.last("close", ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    return prices.withColumn("_close", filled).withColumn("ret", F.try_divide(F.col("_close"), F.lag("_close").over(by_day())) - 1).drop("_close")


def entity_frame(sd: DataFrame, prices: DataFrame) -> DataFrame:
    """(code, kst_date, temp, net, n, ret) of signal dates that are trading days; others are dropped, not rolled."""
    s = sd.groupBy("code", F.col("signal_date").alias("kst_date")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("doc_cnt").alias("n"))
    s = s.select("code", "kst_date", polarity(F.col("pos"), F.col("neg")).alias("temp"), (F.col("pos") - F.col("neg")).cast("double").alias("net"), "n")
    return s.join(returns(prices).select("code", "kst_date", "ret"), ["code", "kst_date"])


def lag_pairs(frame: DataFrame, signal: str, max_lag: int) -> DataFrame:
    """(code, lag, s, r): the signal ``lag`` rows after each return, by position among rows that have a return.

    So with a positive lag prices lead, with a negative one the signal does.
    """
    x = frame.where("ret IS NOT NULL").select("code", "kst_date", F.coalesce(F.col(signal), F.lit(0.0)).alias("s"), "ret")
    lags = range(-max_lag, max_lag + 1)
    wide = x.select("code", "s", *[F.lag("ret", k).over(by_day()).alias(f"r{k}") if k >= 0 else F.lead("ret", -k).over(by_day()).alias(f"r{k}") for k in lags])
    return wide.select("code", "s", F.posexplode(F.array(*[F.col(f"`r{k}`") for k in lags])).alias("at", "r")).select("code", (F.col("at") - max_lag).alias("lag"), "s", "r").where("r IS NOT NULL")


def lead_lag(frame: DataFrame, signal: str = "net", max_lag: int = 5, min_days: int = MIN_DAYS) -> DataFrame:
    """(code, lag, n, r) of codes with enough days: all codes and lags in one aggregate."""
    enough = frame.where("ret IS NOT NULL").groupBy("code").agg(F.count("*").alias("days")).where(F.col("days") >= min_days)
    return lag_pairs(frame, signal, max_lag).join(enough, "code").groupBy("code", "lag").agg(F.count("*").alias("n"), safe_corr(F.col("s"), F.col("r")).alias("r"))


def best_lag(lags: DataFrame) -> DataFrame:
    """(code, lag, r, n, z): the lag with the largest |r| of four digits, the smallest of equals; z of two digits."""
    x = lags.where("r IS NOT NULL").withColumns({"z": F.round(significance(F.col("r"), F.col("n")), 2), "r": F.round("r", 4)})
    return x.groupBy("code").agg(F.max_by(F.struct("lag", "r", "n", "z"), F.struct(F.abs("r"), -F.col("lag"))).alias("best")).select("code", "best.*")


def differenced(frame: DataFrame, signal: str = "net") -> DataFrame:
    """The frame with the signal's change in its place, over rows that have a return."""
    x = frame.where("ret IS NOT NULL").withColumn(signal, F.coalesce(F.col(signal), F.lit(0.0)))
    return x.withColumn(signal, F.col(signal) - F.lag(signal).over(by_day())).where(F.col(signal).isNotNull())


def trend(frame: DataFrame, signal: str = "net", min_days: int = MIN_DAYS) -> DataFrame:
    """(code, days, trend_shared): days with a return, and the signal's correlation with their order where there are enough."""
    x = frame.where("ret IS NOT NULL").select("code", F.coalesce(F.col(signal), F.lit(0.0)).alias("s"), F.row_number().over(by_day()).alias("k"))
    days = x.groupBy("code").agg(F.count("*").alias("days"), F.round(safe_corr(F.col("s"), F.col("k")), 3).alias("trend_shared"))
    return days.withColumn("trend_shared", F.when(F.col("days") >= min_days, F.col("trend_shared")))


def compare(frame: DataFrame, max_lag: int = 5, coverage: DataFrame | None = None) -> DataFrame:
    """Codes by strength of their best lag.

    Beside it the same lag's r on changes and the signal's own trend, to tell a shared trend from a link, and how much of
    the code is labelled (``coverage``: code, canonical, labeled, ratio).  Codes with too few days have no best lag.
    """
    best = best_lag(lead_lag(frame, max_lag=max_lag))
    change = lead_lag(differenced(frame), max_lag=max_lag, min_days=MIN_DAYS - 1).select("code", "lag", F.round("r", 4).alias("diff_r"))
    x = trend(frame).join(best, "code", "left").join(change, ["code", "lag"], "left")
    if coverage is None:
        x = x.withColumns({"labeled": F.lit(None).cast("long"), "canonical": F.lit(None).cast("long"), "ratio": F.lit(None).cast("double")})
    else:
        x = x.join(coverage.select("code", "labeled", "canonical", "ratio"), "code", "left")
    x = x.withColumn("low_coverage", F.coalesce(F.col("ratio") < MIN_LABELED_RATIO, F.lit(False)))
    out = x.select("code", "days", "lag", "r", "n", "z", "diff_r", "trend_shared", "labeled", "canonical", F.round("ratio", 4).alias("labeled_ratio"), "low_coverage")
    return out.orderBy(F.coalesce(F.abs("r"), F.lit(0.0)).desc(), "code")


def matrix(frame: DataFrame, freq: str = "W", least: int = 4) -> DataFrame:
    """(a, b, n, r): correlations of the codes' weekly or monthly mean temperature, both ways, 1 on the diagonal."""
    m = resample_mean(frame, ["code"], "temp", freq, "kst_date").where("temp IS NOT NULL")
    held = m.groupBy("code").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    m = m.join(held, "code").select("code", "bin", "temp")
    a, b = m.select(F.col("code").alias("a"), "bin", F.col("temp").alias("x")), m.select(F.col("code").alias("b"), "bin", F.col("temp").alias("y"))
    got = a.join(b, "bin").groupBy("a", "b").agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("r")).where(F.col("n") >= least)
    return got.select("a", "b", "n", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round("r", 3)).alias("r"))


def wide(frame: DataFrame, codes: list[str], freq: str = "W") -> DataFrame:
    """Weekly mean temperature, a column a code; weeks without any value are dropped."""
    m = resample_mean(frame, ["code"], "temp", freq, "kst_date").where("temp IS NOT NULL")
    return m.groupBy("bin").pivot("code", codes).agg(F.first("temp"))


def basket(prices: DataFrame) -> DataFrame:
    """An equal-weight index over the days on which every code has a close, 100 on the first.

    Closes chain the mean return.  The open is the index of the day before times the mean step from close to open (the
    close where no open is known); the range is that of open and close.  Long chains leave the range of doubles, so the
    index is summed in logarithms: ``log_close`` is the close's, ``log_step`` its change, ``opened`` open over close.
    """
    held = prices.where("close IS NOT NULL")
    codes = held.agg(F.countDistinct("code").alias("codes"))  # one row
    full = held.groupBy("kst_date").agg(F.count("*").alias("n")).join(F.broadcast(codes), F.col("n") == F.col("codes")).select("kst_date")
    x = held.join(full, "kst_date").withColumn("was", F.lag("close").over(by_day()))
    step = x.groupBy("kst_date").agg(F.avg(F.col("close") / F.col("was")).alias("step"), F.avg(F.col("open") / F.col("was")).alias("gap"), F.count("*").alias("n"))
    # one row a day: a bounded series
    day = Window.orderBy("kst_date")
    level = step.withColumns({"log_step": F.log(F.coalesce("step", F.lit(1.0))), "opened": F.coalesce(F.try_divide(F.col("gap"), F.col("step")), F.lit(1.0))})
    chained = F.sum("log_step").over(day.rowsBetween(Window.unboundedPreceding, 0))
    level = level.withColumns({"log_close": F.log(F.lit(100.0)) + chained, "close": 100 * F.exp(chained)})
    level = level.withColumn("open", F.coalesce(F.lag("close").over(day) * F.col("gap"), F.col("close")))
    return level.select("kst_date", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", "n", "log_close", "log_step", "opened")


def signal_summary(compared: DataFrame) -> DataFrame:
    """Counts of significant codes (z of 2 or more, coverage not low) and which side leads."""
    x = compared.where("z >= 2 AND NOT low_coverage")
    return x.agg(F.count("*").alias("significant"), F.count_if(F.col("lag") > 0).alias("price_leads"), F.count_if(F.col("lag") < 0).alias("sentiment_leads"))


def subsample_error(docs: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Mean |difference| of daily net share between all labelled documents and ``cap`` a day: first by rank, or at random."""
    day = ["code", "kst_date"]
    x = docs.where("label IS NOT NULL").withColumns(
        {
            "ranked": F.row_number().over(Window.partitionBy(*day).orderBy(F.coalesce("engagement", F.lit(-1)).desc(), "doc_id")),
            "drawn": F.row_number().over(Window.partitionBy(*day).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id")),
        }
    )
    share = lambda on: F.avg(F.when(on, F.col("label")))
    t = x.groupBy(*day).agg(F.avg("label").alias("t"), share(F.col("ranked") <= cap).alias("t_cap"), share(F.col("drawn") <= cap).alias("t_random"))
    return t.groupBy("code").agg(F.avg(F.abs(F.col("t_cap") - F.col("t"))).alias("cap_error"), F.avg(F.abs(F.col("t_random") - F.col("t"))).alias("random_error"))
