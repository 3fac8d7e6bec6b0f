"""Writing and bookkeeping: inserts, upserts, coverage, aggregates, outlets, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.finance import signal_date
from tidemark.functions.text import REPLACEMENT, article_id, host, registrable, registrable_kr
from tidemark.schema import NON_OPINION_CHANNELS, PLACEHOLDER, STATUS_RANK


# ---- documents ---------------------------------------------------------------------------------------------------
def insert_documents(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` to append: readable titles, one for each (code, source, url); rows without an address never clash."""
    key = ["code", "source", "url"]
    x = new.where((F.trim("title") != "") & ~F.contains(F.col("title"), F.lit(REPLACEMENT)))
    named = x.where("url IS NOT NULL")
    named = named.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).where("_rn = 1").drop("_rn")
    if known is not None:
        named = unseen(named, known)
    return named.unionByName(x.where("url IS NULL"))


def unseen(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose address is not known yet for their code and source."""
    key = ["code", "source", "url"]
    return new.join(known.select(*key).where("url IS NOT NULL").distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, the new row where a key is in either; of several new rows the last by all columns."""
    cols = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *[F.col(c).desc() for c in cols if c not in keys]))).where("_rn = 1").select(*cols)


def purge_stale(prices: DataFrame, source: str, unit_changed: bool = False) -> DataFrame:
    """Rows of the current source; those without one are relabelled, unless the unit changed."""
    kept = prices.where((F.col("source") == source) | (F.col("source").isNull() & F.lit(not unit_changed)))
    return kept.withColumn("source", F.lit(source))


def without_labelled_bodies(bodies: DataFrame, docs: DataFrame) -> DataFrame:
    """Raw bodies whose document has no label yet; the others have served their purpose."""
    return bodies.join(docs.where("label IS NOT NULL").select("doc_id"), "doc_id", "left_anti")


def get_or_create_media(media: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension with unknown (name, channel) pairs added; new ids follow the largest; a dotted name is its own domain."""
    new = names.select("name", "channel").distinct().join(media, ["name", "channel"], "left_anti")
    top = media.agg(F.coalesce(F.max("media_id"), F.lit(-1)).alias("top"))  # one row
    # new outlets of one batch: few, and numbered in one order
    new = new.crossJoin(F.broadcast(top)).withColumn("media_id", F.col("top") + F.row_number().over(Window.orderBy("name", "channel")))
    return media.unionByName(new.select("media_id", "name", F.when(F.contains("name", F.lit(".")), F.col("name")).alias("domain"), F.lit("unknown").alias("tier"), "channel"))


# ---- aggregates --------------------------------------------------------------------------------------------------
def aggregate_sentiment(docs: DataFrame) -> DataFrame:
    """Label counts by code, day, signal day and outlet; duplicates and off-topic rows count, as the tables define it."""
    dated = docs.where("published_utc IS NOT NULL AND kst_date IS NOT NULL")
    return dated.groupBy("code", "kst_date", signal_date(F.col("published_utc")).alias("signal_date"), "media_id").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neu"),
        F.count_if(F.col("label") == -1).alias("neg"),
        F.count_if(F.col("is_relevant") == 0).alias("irrelevant"),
        F.count("*").alias("doc_cnt"),
        F.sum("is_canonical").alias("canonical_cnt"),
        F.count_if(F.col("is_canonical") == 0).alias("spread_sum"),
    )


def tier_rollup(sd: DataFrame, media: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("pos", "neu", "neg", "doc_cnt")]
    return sd.join(media.select("media_id", "tier", "channel"), "media_id").groupBy("code", "kst_date", "signal_date", "tier", "channel").agg(*sums)


def replace_partitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys that ``new`` holds, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write the folders of ``keys`` that ``rows`` has; other folders stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def label_coverage(docs: DataFrame, media: DataFrame) -> DataFrame:
    """Canonical opinion documents of each code, how many are labelled, and the share."""
    opinion = media.where(~F.col("channel").isin(*NON_OPINION_CHANNELS)).select("media_id")
    x = docs.where("is_canonical = 1").join(opinion, "media_id").groupBy("code").agg(F.count("*").alias("canonical"), F.count("label").alias("labeled"))
    return x.withColumn("ratio", F.try_divide(F.col("labeled"), F.col("canonical")))


# ---- coverage ----------------------------------------------------------------------------------------------------
def merge_coverage(reports: DataFrame) -> DataFrame:
    """Ledger rows from reports (code, source, kst_date, run, seq, status, doc_count, last_cursor).

    Within a run the worst status stands and counts add up; a later run replaces an earlier one; attempts count all
    reports; the last known cursor stays.
    """
    key = ["code", "source", "kst_date"]
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    runs = reports.groupBy(*key, "run").agg(F.max_by("status", F.struct(F.element_at(rank, F.col("status")), -F.col("seq"))).alias("status"), F.sum("doc_count").alias("doc_count"))
    last = runs.groupBy(*key).agg(F.max_by(F.struct("status", "doc_count"), "run").alias("last"))
    cursor = F.max_by(F.when(F.col("last_cursor").isNotNull(), F.col("last_cursor")), F.when(F.col("last_cursor").isNotNull(), F.col("seq")))
    tries = reports.groupBy(*key).agg(F.count("*").alias("attempts"), cursor.alias("last_cursor"))
    return last.join(tries, key).select(*key, "last.status", "last.doc_count", "attempts", "last_cursor")


def incomplete_dates(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status").isin("partial", "failed")).select("code", "kst_date").distinct()


# ---- outlets -----------------------------------------------------------------------------------------------------
def match_rules(media: DataFrame, rules: DataFrame) -> DataFrame:
    """(media_id, rule): the first rule that claims each outlet.

    A rule claims outlets of its own channel and of news that bear one of its names, or whose address or name has the
    registrable domain of one of them.
    """
    r = rules.select("rule", F.col("channel").alias("to"), F.explode(_names()).alias("alias"))
    doms = F.filter(F.array_distinct(F.array(registrable(F.col("domain")), registrable(F.col("name")))), lambda x: x.isNotNull())
    m = media.select("media_id", F.trim("name").alias("alias"), "channel", doms.alias("doms"))
    by_name = m.join(r, "alias").select("media_id", "rule", "channel", "to")
    by_domain = m.select("media_id", "channel", F.explode("doms").alias("dom")).join(r.select("rule", "to", registrable(F.col("alias")).alias("dom")).where("dom IS NOT NULL"), "dom")
    hit = by_name.union(by_domain.select("media_id", "rule", "channel", "to")).where("channel = 'news' OR channel = to")
    return hit.groupBy("media_id").agg(F.min("rule").alias("rule"))


def _names() -> Column:
    """A rule's names: its aliases, with its own name first where that is not among them."""
    return F.when(F.array_contains("aliases", F.col("canonical")), F.col("aliases")).otherwise(F.concat(F.array("canonical"), F.col("aliases")))


def _merged(media: DataFrame, rules: DataFrame) -> DataFrame:
    """(canonical, channel, tier, domain, keep, members) for each new name: rules of one name and channel end as the last of them.

    Rules that claim nothing have no members.
    """
    held = match_rules(media, rules).join(media.select("media_id", "domain"), "media_id")
    known = F.col("domain").isNotNull()
    hits = held.groupBy("rule").agg(F.min("media_id").alias("keep"), F.collect_list("media_id").alias("members"), F.min_by(F.when(known, F.col("domain")), F.when(known, F.col("media_id"))).alias("seen"))
    dotted = F.element_at(F.concat(F.filter(_names(), lambda n: F.contains(n, F.lit("."))), F.array(F.lit(None).cast("string"))), 1)
    each = rules.select("rule", "canonical", "channel", "tier", dotted.alias("dotted")).join(hits, "rule", "left")
    at = F.when(F.col("keep").isNotNull(), F.col("rule"))
    last = each.groupBy("canonical", "channel").agg(
        F.max_by(F.struct("keep", "tier", F.coalesce("dotted", "seen").alias("domain")), at).alias("won"),
        F.min_by("tier", "rule").alias("first_tier"),
        F.flatten(F.collect_list(F.coalesce("members", F.array().cast("array<bigint>")))).alias("members"),
        F.min("rule").alias("rule"),
    )
    lone = F.when(F.contains("canonical", F.lit(".")), F.col("canonical"))
    return last.select("rule", "canonical", "channel", F.coalesce("won.tier", "first_tier").alias("tier"), F.when(F.size("members") > 0, F.col("won.domain")).otherwise(lone).alias("domain"), F.col("won.keep").alias("keep"), "members")


def merge_media(media: DataFrame, rules: DataFrame) -> DataFrame:
    """(media_id, keep, name, tier, channel): outlets of one name become one row, under the rule's name, tier and channel."""
    named = _merged(media, rules).where("keep IS NOT NULL").select(F.explode("members").alias("media_id"), "keep", F.col("canonical").alias("to_name"), F.col("tier").alias("to_tier"), F.col("channel").alias("to_channel"))
    x = media.select("media_id", "name", "tier", "channel").join(named, "media_id", "left")
    return x.select("media_id", F.coalesce("keep", "media_id").alias("keep"), F.coalesce("to_name", "name").alias("name"), F.coalesce("to_tier", "tier").alias("tier"), F.coalesce("to_channel", "channel").alias("channel"))


def merged_outlets(media: DataFrame, rules: DataFrame) -> DataFrame:
    """The dimension after ``merge_media``: kept and untouched outlets, and new ones for rules that claim nothing."""
    names_ = _merged(media, rules)
    mapping = merge_media(media, rules)
    domain = names_.where("keep IS NOT NULL").select(F.col("keep").alias("media_id"), F.col("domain").alias("to_domain"))
    kept = mapping.where("media_id = keep").join(media.select("media_id", "domain"), "media_id").join(domain, "media_id", "left")
    kept = kept.select("media_id", "name", F.coalesce("to_domain", "domain").alias("domain"), "tier", "channel")
    lone = names_.where("keep IS NULL").join(kept.select(F.col("name").alias("canonical"), "channel"), ["canonical", "channel"], "left_anti")
    top = media.agg(F.coalesce(F.max("media_id"), F.lit(-1)).alias("top"))  # one row
    # as many rows as rules without outlets: a file kept by hand
    new = lone.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy("rule"))).alias("media_id"), F.col("canonical").alias("name"), "domain", "tier", "channel")
    return kept.unionByName(new)


def repoint(facts: DataFrame, mapping: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Facts on the kept outlets, added up again."""
    x = facts.join(mapping.select("media_id", "keep"), "media_id").drop("media_id").withColumnRenamed("keep", "media_id")
    return x.groupBy(*keys, "media_id").agg(*[F.sum(c).alias(c) for c in sums])


def oid_index(docs: DataFrame, media: DataFrame) -> DataFrame:
    """(oid, name, tier): the named news outlet of the first document seen under each outlet number."""
    named = media.where((F.col("name") != PLACEHOLDER) & (F.col("channel") == "news")).select("media_id", "name", "tier")
    x = docs.join(named, "media_id").withColumn("oid", article_id(F.col("url"))).where("oid IS NOT NULL")
    return x.groupBy("oid").agg(F.min_by(F.struct("name", "tier"), "doc_id").alias("o")).select("oid", "o.*")


def recover_press(docs: DataFrame, media: DataFrame) -> DataFrame:
    """(doc_id, outlet, tier) for documents of the placeholder: by outlet number, else by the address's domain.

    Documents with neither stay with the placeholder and are not returned.
    """
    unnamed = docs.join(media.where(F.col("name") == PLACEHOLDER).select("media_id"), "media_id").select("doc_id", article_id(F.col("url")).alias("oid"), F.nullif(host(F.col("url")), F.lit("")).alias("host"))
    x = unnamed.join(oid_index(docs, media), "oid", "left")
    return x.where("name IS NOT NULL OR host IS NOT NULL").select("doc_id", F.coalesce("name", registrable_kr(F.col("host"))).alias("outlet"), F.coalesce("tier", F.lit("unknown")).alias("tier"))


# ---- snapshots and logs ------------------------------------------------------------------------------------------
def work_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where none is set, a temporary one, and that in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tidemark-")
    return found.rstrip("/")


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], target: str, forbidden: tuple[str, ...] = ("body", "title")) -> dict[str, int]:
    """Write tables beside ``target`` and move them there in one rename; refuses empty tables and text columns."""
    for name, df in tables.items():
        if leaked := [c for c in df.columns if c in forbidden]:
            raise ValueError(f"{name} would leak {leaked}")
    staging, counts = f"{target.rstrip('/')}.{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{staging}/{name}.parquet").count()
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if empty := [k for k, n in counts.items() if not n]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
        raise ValueError(f"empty: {empty}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(target), True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move the snapshot to {target}")
    return counts


class RunLog:
    """Appends a row for the start and the end, good or bad, of a stage."""

    SCHEMA = "run_id string, stage string, code string, at timestamp, status string, stats_json string, error string"

    def __init__(self, spark: SparkSession, path: str, stage: str, code: str | None = None):
        self.spark, self.path, self.stage, self.code, self.run_id, self.stats = spark, path, stage, code, uuid.uuid4().hex, None

    def _add(self, status: str, error: str | None = None) -> None:
        import datetime
        import json

        row = (self.run_id, self.stage, self.code, datetime.datetime.now(datetime.UTC), status, json.dumps(self.stats) if self.stats is not None else None, error)
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("append").parquet(self.path)

    def finish(self, stats: dict) -> None:
        self.stats = stats

    def __enter__(self) -> RunLog:
        self._add("running")
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._add("failed" if error else "done", str(error)[:200] if error else None)
