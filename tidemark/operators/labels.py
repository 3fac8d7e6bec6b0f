"""Choosing documents to label, reading labels, and handing them on to duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schema import COMMUNITY_MIN_ENGAGEMENT, NON_OPINION_CHANNELS, SCORE_BATCH

COMMUNITY = ("community", "cafe")


def engaged(least: int = COMMUNITY_MIN_ENGAGEMENT) -> Column:
    """Community posts count only with enough engagement, or where it is not known."""
    return ~F.col("channel").isin(*COMMUNITY) | F.col("engagement").isNull() | (F.col("engagement") >= least)


#: Tiers in the order in which their documents are labelled; others come last (fixed values).
TIER_ORDER = ("major", "daily", "online", "unknown", "blog")


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(TIER_ORDER))
    for rank, name in enumerate(TIER_ORDER):
        out = F.when(tier == name, rank).otherwise(out)
    return out


def prompt(channel: Column) -> Column:
    return F.concat(
        F.lit("Label the market sentiment of each post as positive, negative or neutral."),
        F.when(channel.isin(*COMMUNITY), " Posts are informal; sarcasm counts as negative.").otherwise(" Posts are headlines."),
    )


def daily_cap(docs: DataFrame, cap: int, keys: tuple[str, ...] = ("code", "kst_date")) -> DataFrame:
    """The first ``cap`` documents of a code and day: press before community, better tiers, more engagement, older ids."""
    community = F.col("channel").isin(*COMMUNITY)
    order = [community.cast("int"), F.when(~community, tier_rank(F.col("tier"))).asc_nulls_first(), F.coalesce("engagement", F.lit(-1)).desc(), F.col("doc_id")]
    return docs.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= cap).drop("_rn")


def pending(docs: DataFrame, media: DataFrame, cap: int | None = None, limit: int | None = None, channel: str | None = None, non_opinion: bool = False, since: Column | None = None) -> DataFrame:
    """Canonical documents without a label that are worth one, newest first."""
    x = docs.where("label IS NULL AND is_canonical = 1").join(media.select("media_id", "tier", "channel"), "media_id").where(engaged())
    if not non_opinion:
        x = x.where(~F.col("channel").isin(*NON_OPINION_CHANNELS))
    if channel:
        x = x.where(F.col("channel") == channel)
    if since is not None:
        x = x.where(F.col("published_utc") >= since)
    order = [F.col("published_utc").desc(), F.col("doc_id").desc()]
    if cap is not None:
        x, order = daily_cap(x, cap), [F.col("doc_id").desc()]
    x = x.orderBy(*order)
    return x if limit is None else x.limit(limit)


REPLY = "array<struct<id:string,label:string,relevant:string,confidence:string,why:string>>"


def read_labels(replies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scorers' JSON replies as labels; unknown labels and ids that were not asked for are dropped.

    Values come as a model writes them: numbers as text, "false" or 0 for not relevant, no confidence for 0.
    """
    table = F.create_map(F.lit("positive"), F.lit(1), F.lit("negative"), F.lit(-1), F.lit("neutral"), F.lit(0))
    x = replies.select(F.explode(F.from_json("reply", REPLY)).alias("r")).select(
        F.expr("try_cast(trim(r.id) AS bigint)").alias("doc_id"),
        F.try_element_at(table, F.lower(F.trim("r.label"))).alias("label"),
        (~F.coalesce(F.col("r.relevant"), F.lit("true")).isin("false", "0", "0.0")).cast("int").alias("is_relevant"),
        F.coalesce(F.expr("try_cast(r.confidence AS double)"), F.lit(0.0)).alias("confidence"),
        F.nullif(F.left("r.why", F.lit(150)), F.lit("")).alias("why"),
    )
    return x.where("label IS NOT NULL").join(wanted.select("doc_id"), "doc_id", "left_semi")


Scorer = Callable[[str, list[tuple[int, str]]], list[tuple[int, str]]]


def word_scorer(channel: str, items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """A stand-in for a remote model: labels by words in the title."""
    good, bad = ("purchase", "signup", "up", "gain"), ("error", "down", "loss")
    return [(k, "positive" if any(w in t for w in good) else "negative" if any(w in t for w in bad) else "neutral") for k, t in items]


def score(docs: DataFrame, scorer: Scorer = word_scorer, batch: int = SCORE_BATCH) -> DataFrame:
    """(reply): JSON replies for ``read_labels``, batches of one channel at a time.

    A failing batch is halved until single rows fail alone.
    """
    import json

    def ask(channel: str, items: list[tuple[int, str]]) -> list[tuple[int, str]]:
        try:
            return scorer(channel, items)
        except Exception:
            if len(items) == 1:
                return []
            half = len(items) // 2
            return ask(channel, items[:half]) + ask(channel, items[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for channel, part in frame.groupby("channel", sort=True):
                items = list(zip(part["doc_id"].tolist(), part["title"].tolist(), strict=True))
                for lo in range(0, len(items), batch):
                    got = [{"id": k, "label": word, "relevant": True} for k, word in ask(channel, items[lo : lo + batch])]
                    yield pd.DataFrame({"reply": [json.dumps(got)]})

    return docs.select("doc_id", "channel", "title").mapInPandas(run, "reply string")


def inherit(docs: DataFrame) -> DataFrame:
    """Unlabelled duplicates of a labelled canonical, with its label, relevance, confidence and prompt version."""
    key = ["code", "dup_group_id"]
    given = docs.where("is_canonical = 1 AND label IS NOT NULL AND dup_group_id IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct("label", "is_relevant", "confidence", "prompt_version"), "doc_id").alias("given"))
    return docs.where("is_canonical = 0 AND label IS NULL").select("doc_id", *key).join(given, key).select("doc_id", "given.*", F.lit("inherited").alias("label_model"))
