"""Column functions on signals, prices and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import CUTOFF, MIN_CORR_POINTS, SHRINKAGE, TIER_WEIGHTS


def to_kst(utc: Column) -> Column:
    return utc + F.expr("INTERVAL 9 HOURS")


def kst_date(utc: Column) -> Column:
    return F.to_date(to_kst(utc))


def to_utc(local: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_utc_timestamp(local, zone)


def signal_date(utc: Column, cutoff: str = CUTOFF) -> Column:
    """The Korean day whose opening a document can still act on: its own up to the cutoff's minute, else the next."""
    local = to_kst(utc)
    return F.when(F.date_format(local, "HH:mm") <= cutoff, F.to_date(local)).otherwise(F.date_add(F.to_date(local), 1))


def polarity(pos: Column, neg: Column, shrink: float = SHRINKAGE) -> Column:
    """Net share of labelled opinions, shrunk towards 0 on thin days; null without opinions."""
    n = pos + neg
    return F.when(n > 0, (pos - neg) / n * (n / (n + shrink)))


def tier_weight(tier: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (weights or TIER_WEIGHTS).items() for x in kv])
    return F.coalesce(F.try_element_at(table, tier), F.lit(0.0))


def parse_weights(text: str | None) -> dict[str, float]:
    """``tier:weight,...`` over the defaults; parts without a colon are skipped, bad ones refused."""
    out = dict(TIER_WEIGHTS)
    for part in (text or "").split(","):
        if ":" not in part:
            continue
        tier, _, value = part.partition(":")
        number = float(value)
        if tier.strip() not in out or not 0 <= number <= 1000:
            raise ValueError(f"bad weight {part!r}")
        out[tier.strip()] = number
    return out


def fee_charge(delta: Column, price: Column, fees: dict[str, float]) -> Column:
    rate = F.lit(fees["slip"]) + F.when(delta > 0, fees["buy"]).when(delta < 0, fees["sell"] + fees["tax"]).otherwise(0.0)
    return F.abs(delta) * price * rate / 1e4


def carry_charge(position: Column, close: Column, cash: Column, fees: dict[str, float]) -> Column:
    """A day's cost of a short position and of negative cash."""
    short = F.when(position < 0, -position * close * fees["borrow"]).otherwise(0.0)
    debt = F.when(cash < 0, -cash * fees["financing"]).otherwise(0.0)
    return (short + debt) / 1e4 / 365


def safe_corr(x: Column, y: Column, least: int = MIN_CORR_POINTS) -> Column:
    """Aggregate: Pearson's r; null on few points or no variance (corr itself fails there under ANSI)."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when((n >= least) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def significance(r: Column, n: Column) -> Column:
    return F.abs(r) * F.sqrt(F.greatest(n - 3, F.lit(1)))


def tradable_open(open_: Column, close: Column) -> Column:
    return F.coalesce(F.nullif(open_, F.lit(0.0)), close, F.lit(0.0))


def week_ending_friday(d: Column) -> Column:
    return F.date_add(d, F.pmod(6 - F.dayofweek(d), F.lit(7)))


def week_ending_sunday(d: Column) -> Column:
    return F.date_add(d, F.pmod(8 - F.dayofweek(d), F.lit(7)))


def bin_end(d: Column, freq: str) -> Column:
    return {"daily": d, "weekly": week_ending_friday(d), "W": week_ending_sunday(d), "monthly": F.last_day(d), "ME": F.last_day(d)}[freq]


def readiness(price_days: Column, docs: Column, label_pct: Column) -> Column:
    """How far a code is: all there, being labelled, prices without documents yet, or still preparing."""
    priced = price_days >= 2000
    return F.when(priced & (label_pct >= 70), "ready").when(priced & (docs > 0), "labelling").when(priced, "collecting").otherwise("preparing")
