"""Tables of the engine and the parameters that fix its results."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Weight of each outlet tier in the signal (fixed values).
TIER_WEIGHTS = {
    "major": 5.0,
    "daily": 2.0,
    "online": 1.0,
    "wire": 4.0,
    "global": 2.0,
    "crypto": 1.0,
    "unknown": 1.0,
    "blog": 0.05,
    "aggregator": 0.0,
    "vendor": 0.0,
    "algo": 0.0,
    "pr": 0.0,
    "community": 0.0,
}
#: Channels whose documents hold no opinion (fixed values).
NON_OPINION_CHANNELS = ("vendor", "algo", "pr", "aggregator")
#: Name of the outlet that stands for a missing one (fixed value).
PLACEHOLDER = "미상 언론사"
CUTOFF = "08:50"
SHRINKAGE = 10.0
SIMHASH_DISTANCE = 3
FUZZY_SCORE = 95.0
AUTHOR_DAILY_CAP = 3
BUCKET_LIMIT = 400
COMMUNITY_MIN_ENGAGEMENT = 20
SCORE_BATCH = 15
IMBALANCE_RATIO = 20.0
MIN_DAYS = 30
MIN_LABELED_RATIO = 0.60
MIN_CORR_POINTS = 10
#: Severity of a coverage status within a run (fixed values).
STATUS_RANK = {"empty": 0, "pending": 0, "completed": 1, "partial": 2, "failed": 3}
#: buy, sell, tax, slippage, borrow, financing in basis points (fixed values).
FEES = {"buy": 1.5, "sell": 1.5, "tax": 18.0, "slip": 5.0, "borrow": 280.0, "financing": 938.0}
NO_FEES = dict.fromkeys(FEES, 0.0)

DDL = {
    "entities": "code STRING, name STRING, kind STRING, market STRING, priority INT, calendar STRING, locales ARRAY<ARRAY<STRING>>, aliases ARRAY<STRING>, exclude ARRAY<STRING>, queries ARRAY<STRING>, is_active INT",
    "media": "media_id BIGINT, name STRING, domain STRING, naver_oid STRING, tier STRING, channel STRING",
    "fee_schedule": "effective_from DATE, buy_bps DOUBLE, sell_bps DOUBLE, tax_bps DOUBLE, slippage_bps DOUBLE, borrow_bps_annual DOUBLE, financing_bps_annual DOUBLE",
    "prices": "code STRING, kst_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, is_adjusted INT, source STRING",
    "raw_documents": "doc_id BIGINT, body STRING, fetched_utc TIMESTAMP",
    "documents": "doc_id BIGINT, code STRING, media_id BIGINT, source STRING, url STRING, title STRING, norm_title STRING, title_hash STRING, body_hash STRING, simhash BIGINT, author STRING, engagement BIGINT, endorse_up BIGINT, endorse_down BIGINT, published_utc TIMESTAMP, published_kst_date DATE, collected_utc TIMESTAMP, ts_confidence STRING, dup_group_id STRING, is_canonical INT, label INT, is_relevant INT, confidence DOUBLE, label_model STRING, prompt_version STRING, ai_reasoning STRING, labeled_at TIMESTAMP",
    "sentiment_daily": "code STRING, kst_date DATE, signal_date DATE, media_id BIGINT, pos BIGINT, neu BIGINT, neg BIGINT, irrelevant BIGINT, doc_cnt BIGINT, canonical_cnt BIGINT, spread_sum BIGINT",
    "coverage": "code STRING, source STRING, kst_date DATE, status STRING, doc_count BIGINT, last_cursor STRING, attempts INT, error STRING, updated_utc TIMESTAMP",
    "pipeline_runs": "run_id STRING, stage STRING, code STRING, started_utc TIMESTAMP, finished_utc TIMESTAMP, status STRING, stats_json STRING, error STRING",
}


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC as its time zone."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
