"""Experiments: a distilled label model, smoothed comparisons, frames for a replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.finance import fee_charge, polarity, safe_corr
from tidemark.operators import backtest as bt
from tidemark.operators.stats import by_day, lag_pairs
from tidemark.schema import FEES


def tone_compare(frame: DataFrame, max_lag: int = 5, rows: int = 20) -> DataFrame:
    """(code, lag, n, r) between trailing means of the signal, ``lag`` rows later, and of the return."""
    w = by_day().rowsBetween(-(rows - 1), 0)
    x = frame.where("ret IS NOT NULL").select("code", "kst_date", F.avg("net").over(w).alias("s"), F.avg("ret").over(w).alias("ret"))
    return lag_pairs(x, "s", max_lag).groupBy("code", "lag").agg(F.count("*").alias("n"), safe_corr(F.col("s"), F.col("r")).alias("r"))


def frames(prices: DataFrame, sd: DataFrame, media: DataFrame, weights: dict[str, float] | None = None, fees: dict[str, float] = FEES, amount: float = 1_000_000.0, fee: float = 0.00065) -> DataFrame:
    """Day by day what a replay shows: the trader, holding, and monthly buying, with the day's signal, counts and event.

    The trader and the holder start with the trader's peak capital.  Monthly buying starts with the strategy's first day.
    """
    path = bt.backtest(prices, sd, media, weights, "forward", "long_only", fees)
    own = bt.summary(path, fees).select("code", "peak_capital", "first_price")
    x = bt.rounded(path).join(own, "code")
    peak = F.col("peak_capital")
    shares = peak / F.col("first_price")
    held = F.bround(shares * F.col("close") - peak - fee_charge(shares, F.col("first_price"), fees), 0)
    upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.trunc("kst_date", "month") != F.trunc(F.lag("kst_date").over(by_day()), "month"), F.lit(True))
    x = x.withColumns({"buys": F.when(new, amount).otherwise(0.0), "bh": held})
    x = x.withColumns({"invested": F.sum("buys").over(upto), "units": F.sum(F.when(F.col("close") > 0, F.col("buys") * (1 - fee) / F.col("close")).otherwise(0.0)).over(upto)})
    counts = sd.groupBy("code", F.col("signal_date").alias("kst_date")).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "doc_cnt")])
    x = x.join(counts, ["code", "kst_date"], "left")
    zero, docs = F.lit(0), F.coalesce("doc_cnt", F.lit(0))
    moved = F.round("delta", 4)
    event = F.when(moved > 0, "buy").when(moved < 0, "sell").when((docs > 100) & (F.col("raw") > 15), "buzz")
    worth = F.bround(F.col("units") * F.col("close"), 0)
    return x.select(
        "code",
        "kst_date",
        F.col("close").alias("price"),
        (peak + F.col("net")).alias("trader_val"),
        (F.try_divide(F.col("net"), peak) * 100).alias("trader_roi"),
        F.round("position", 4).alias("trader_pos"),
        worth.alias("dca_val"),
        F.round((worth - F.col("invested")) / F.col("invested") * 100, 2).alias("dca_roi"),
        (peak + F.col("bh")).alias("bh_val"),
        (F.try_divide(F.col("bh"), peak) * 100).alias("bh_roi"),
        F.round("raw", 4).alias("raw_signal"),
        F.coalesce("pos", zero).alias("pos_cnt"),
        F.coalesce("neg", zero).alias("neg_cnt"),
        docs.alias("doc_cnt"),
        moved.alias("delta"),
        event.alias("event"),
    )


#: The classes that a distilled model tells apart: positive, neutral, negative, not about the code (fixed values).
CLASSES = ("P", "N0", "N", "X")


def label_class(label: Column, relevant: Column) -> Column:
    return F.when(relevant == 0, "X").when(label == 1, "P").when(label == -1, "N").otherwise("N0")


def word_grams(text: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Character grams inside words, each word with a space on either side; a word shorter than a gram is one itself."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))

    # a size beyond the word adds nothing once the whole word has been taken
    sized = lambda w: F.flatten(F.array(*[F.when((F.length(w) > n - 1) | F.lit(n == sizes[0]), grams(w, n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    return F.flatten(F.transform(words, sized))


def agreement(labelled: DataFrame) -> DataFrame:
    """(code, days, r_daily, r_ma20, mean_abs): the daily polarity of ``guess`` against that of ``truth``."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    days = labelled.groupBy("code", "kst_date").agg(count("truth", "P").alias("tp"), count("truth", "N").alias("tn"), count("guess", "P").alias("gp"), count("guess", "N").alias("gn")).where("tp + tn + gp + gn > 0")
    x = days.select("code", "kst_date", F.coalesce(polarity(F.col("tp"), F.col("tn")), F.lit(0.0)).alias("a"), F.coalesce(polarity(F.col("gp"), F.col("gn")), F.lit(0.0)).alias("b"))
    w = by_day().rowsBetween(-19, 0)
    x = x.withColumns({"am": F.avg("a").over(w), "bm": F.avg("b").over(w)})
    return x.groupBy("code").agg(F.count("*").alias("days"), safe_corr(F.col("a"), F.col("b")).alias("r_daily"), safe_corr(F.col("am"), F.col("bm")).alias("r_ma20"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs"))


def macro_f1(labelled: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1) over the classes that occur as truth or guess."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("truth") == k).alias("t"), (F.col("guess") == k).alias("g")) for k in CLASSES])).alias("c")
    by = labelled.select(each).groupBy("c.k").agg(F.count_if(F.col("c.t") & F.col("c.g")).alias("hit"), F.count_if(F.col("c.t")).alias("t"), F.count_if(F.col("c.g")).alias("g")).where("t + g > 0")
    out = by.agg(F.sum("t").alias("n"), F.try_divide(F.sum("hit"), F.sum("t")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("t") + F.col("g"))).alias("macro_f1"))
    return out.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy", "macro_f1")


def distill(docs: DataFrame, split: str, least: int = 3, vocabulary: int = 400_000, strength: float = 3.0) -> DataFrame:
    """(doc_id, code, kst_date, truth, guess) from ``split`` on, by a linear model of the labels before it.

    Grams of "[code] title" in at least ``least`` documents, weighted by inverse frequency; classes weigh alike.  Counts
    inside one title are nearly always 1, so they are not damped.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, StringIndexer

    text = F.concat(F.lit("["), "code", F.lit("] "), "title")
    x = docs.select("doc_id", "code", "kst_date", word_grams(text).alias("grams"), label_class(F.col("label"), F.col("is_relevant")).alias("truth"))
    day = F.lit(split).cast("date")
    train = x.where(F.col("kst_date") < day)
    sizes = {r["truth"]: r["count"] for r in train.groupBy("truth").count().collect()}  # a row a class
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for name, n in sizes.items():
        weight = F.when(F.col("truth") == name, F.lit(total / (len(sizes) * n))).otherwise(weight)
    stages = [
        StringIndexer(inputCol="truth", outputCol="y", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="grams", outputCol="tf", minDF=float(least), vocabSize=vocabulary),
        IDF(inputCol="tf", outputCol="raw"),
        Normalizer(inputCol="raw", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=50, regParam=1 / (strength * total), standardization=False),
    ]
    model = Pipeline(stages=stages).fit(train.withColumn("w", weight))
    names = IndexToString(inputCol="prediction", outputCol="guess", labels=model.stages[0].labels)
    later = x.where(F.col("kst_date") >= day)
    for stage in model.stages[1:]:
        later = stage.transform(later)
    return names.transform(later).select("doc_id", "code", "kst_date", "truth", "guess")
