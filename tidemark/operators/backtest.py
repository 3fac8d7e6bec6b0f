"""Sentiment-following strategies: signal, positions, cash, summary, and the strategies they are compared with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.finance import fee_charge, tier_weight, tradable_open
from tidemark.schema import IMBALANCE_RATIO


def by_day() -> WindowSpec:
    return Window.partitionBy("code").orderBy("kst_date")


def upto() -> WindowSpec:
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def tier_signal(sd: DataFrame, media: DataFrame) -> DataFrame:
    """Counts by signal date and tier, the part that does not depend on weights."""
    return sd.join(media.select("media_id", "tier"), "media_id").groupBy("code", "signal_date", "tier").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("doc_cnt").alias("doc_cnt"))


def assign_trading_day(signal: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``kst_date``, the first trading day on or after the signal's; signals after the last price are dropped.

    One sort of both sides by code and date; no inequality join.
    """
    days = prices.select("code", F.col("kst_date").alias("at"), F.lit(1).alias("side")).distinct()
    asked = signal.select("code", F.col("signal_date").alias("at"), F.lit(0).alias("side")).distinct()
    w = Window.partitionBy("code").orderBy("at", "side").rowsBetween(0, Window.unboundedFollowing)
    found = days.union(asked).withColumn("kst_date", F.first(F.when(F.col("side") == 1, F.col("at")), ignorenulls=True).over(w))
    return signal.join(found.where("side = 0 AND kst_date IS NOT NULL").select("code", F.col("at").alias("signal_date"), "kst_date"), ["code", "signal_date"])


def weighted_signal(signal: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(code, kst_date, raw): weighted net counts by trading day."""
    return signal.groupBy("code", "kst_date").agg(F.sum(tier_weight(F.col("tier"), weights) * (F.col("pos") - F.col("neg"))).alias("raw"))


def align(prices: DataFrame, raw: DataFrame) -> DataFrame:
    """Price days from one before the first signal on, with the raw signal, 0 where there is none."""
    x = prices.select("code", "kst_date", tradable_open(F.col("open"), F.col("close")).alias("open"), "close").join(raw, ["code", "kst_date"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    x = x.withColumn("rn", F.row_number().over(by_day()))
    x = x.withColumn("first_rn", F.min(F.when(F.col("raw") != 0, F.col("rn"))).over(Window.partitionBy("code")))
    return x.where(F.col("rn") >= F.greatest(F.lit(1), F.col("first_rn") - 1)).drop("first_rn")


def positions(days: DataFrame, direction: str = "forward", limit: str = "long_only") -> DataFrame:
    """Adds position and delta.  Long-only is the running sum lifted by its lowest point below zero, so no fold is needed."""
    sign = 1.0 if direction == "forward" else -1.0
    px = F.col("open")
    x = days.withColumn("wish", F.when(px > 0, sign * F.col("raw")).otherwise(0.0)).withColumn("_s", F.sum("wish").over(upto()))
    pos = F.col("_s") if limit == "unlimited" else F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(upto()))
    x = x.withColumn("position", pos)
    return x.withColumn("delta", F.col("position") - F.coalesce(F.lag("position").over(by_day()), F.lit(0.0))).drop("_s")


def simulate(days: DataFrame, fees: dict[str, float]) -> DataFrame:
    """Adds cost, carry, cash, equity and net P&L.

    Without carry rates cash is a running sum.  With them a day's charge depends on the sign of cash after the trade, so
    a code's days are folded in order, in one task a code: a row a trading day, a few thousand.
    """
    x = positions_cost(days, fees)
    if not fees["borrow"] and not fees["financing"]:
        out = x.withColumn("carry", F.lit(0.0)).withColumn("cash", -F.sum(F.col("delta") * F.col("open") + F.col("cost")).over(upto()))
    else:
        columns = ["code", "kst_date", "open", "close", "raw", "position", "delta", "cost"]

        def fold(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("kst_date")
            cash, money, carried = 0.0, [], []
            for price, close, position, delta, cost in zip(*(frame[c].tolist() for c in ("open", "close", "position", "delta", "cost")), strict=True):
                cash -= delta * price + cost
                short = -position * close * fees["borrow"] if position < 0 else 0.0
                carry = (short + (-cash * fees["financing"] if cash < 0 else 0.0)) / 1e4 / 365
                cash -= carry
                money.append(cash)
                carried.append(carry)
            return frame.assign(carry=carried, cash=money)

        kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
        out = x.select(*columns).groupBy("code").applyInPandas(fold, ", ".join([*[f"{c} {kinds[c]}" for c in columns], "carry double", "cash double"]))
    out = out.withColumn("equity", F.col("position") * F.col("close"))
    return out.withColumn("net", F.col("cash") + F.col("equity"))


def positions_cost(days: DataFrame, fees: dict[str, float]) -> DataFrame:
    return days.withColumn("cost", fee_charge(F.col("delta"), F.col("open"), fees))


def rounded(path: DataFrame) -> DataFrame:
    """Money in whole units, as it is reported; peaks and drawdowns are taken from these."""
    return path.withColumns({c: F.bround(c, 0) for c in ("cash", "equity", "net")})


def drawdown(path: DataFrame) -> DataFrame:
    return path.withColumn("drawdown", F.col("net") - F.max("net").over(upto()))


def summary(path: DataFrame, fees: dict[str, float]) -> DataFrame:
    """One row a code: net result, peak capital, return, drawdown, trades, costs, and buying and holding instead."""
    x = drawdown(rounded(path))
    s = x.groupBy("code").agg(
        F.count("*").alias("days"),
        F.max_by("net", "kst_date").alias("net"),
        F.greatest(-F.min("cash"), F.coalesce(F.max(F.when(F.col("position") < 0, F.abs("equity"))), F.lit(0.0)), F.lit(1.0)).alias("peak_capital"),
        F.min("drawdown").alias("mdd"),
        F.count_if(F.abs("delta") > 1e-9).alias("trades"),
        F.sum("cost").alias("cost"),
        F.sum("carry").alias("carry"),
        F.min_by(F.when(F.col("open") > 0, F.col("open")), F.when(F.col("open") > 0, F.col("kst_date"))).alias("first_price"),
        F.max_by("close", "kst_date").alias("last_close"),
    )
    return s.withColumn("return_pct", F.col("net") / F.col("peak_capital") * 100).withColumn("buy_hold", buy_hold(F.col("peak_capital"), F.col("first_price"), F.col("last_close"), fees))


def buy_hold(capital: Column, first: Column, last: Column, fees: dict[str, float]) -> Column:
    """Result of putting the capital into shares on the first day, less the cost of entry."""
    shares = capital / first
    return shares * (last - first) - fee_charge(shares, first, fees)


def backtest(prices: DataFrame, sd: DataFrame, media: DataFrame, weights: dict[str, float] | None = None, direction: str = "forward", limit: str = "long_only", fees: dict[str, float] | None = None) -> DataFrame:
    """The daily path of every code that has prices and a signal that is not all zero."""
    from tidemark.schema import NO_FEES

    raw = weighted_signal(assign_trading_day(tier_signal(sd, media), prices), weights)
    return simulate(positions(align(prices, raw), direction, limit), fees or NO_FEES)


def imbalance(assigned: DataFrame, ratio: float = IMBALANCE_RATIO, top: int = 5) -> DataFrame:
    """Trading days whose documents outnumber the code's median day by ``ratio``, the largest ``top``; codes of over 3 days only.

    ``assigned`` has the counts by trading day, as ``assign_trading_day`` gives them.
    """
    daily = assigned.groupBy("code", "kst_date").agg(F.sum("doc_cnt").alias("docs"))
    mid = daily.groupBy("code").agg(F.median("docs").alias("mid"), F.count("*").alias("n"))
    x = daily.join(mid, "code").where("n > 3").withColumn("ratio", F.col("docs") / F.when(F.col("mid") == 0, 1.0).otherwise(F.col("mid"))).where(F.col("ratio") >= ratio)
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.col("docs").desc(), "kst_date"))).where(F.col("rn") <= top).select("code", "kst_date", "docs", "ratio")


def dca(prices: DataFrame, amount: float = 1_000_000.0, fee: float = 0.00065) -> DataFrame:
    """A fixed sum invested at each month's first close, less a fee: invested, shares and value by day."""
    month = F.trunc("kst_date", "month")
    new = F.coalesce(month != F.trunc(F.lag("kst_date").over(by_day()), "month"), F.lit(True))
    x = prices.where("close > 0").withColumn("buys", F.when(new, amount).otherwise(0.0))
    x = x.withColumns({"invested": F.sum("buys").over(upto()), "shares": F.sum(F.col("buys") * (1 - fee) / F.col("close")).over(upto())})
    return x.withColumn("value", F.col("shares") * F.col("close"))
