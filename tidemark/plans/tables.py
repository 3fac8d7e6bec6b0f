"""Queries on joins, aggregates, windows, limits, set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import backtest as bt
from tidemark.operators import dedup, labels, ledger, series, stats
from tidemark.plans.proxies import coverage, documents, entities, media, plain, plain_sql, prices, sentiment_daily, table, titles, with_
from tidemark.plans.registry import query
from tidemark.plans.scalar import _PLAIN, _SIGNAL, _SIM, _plain
from tidemark.schema import PLACEHOLDER

D = with_
SD = "sd"

# ---- sources -----------------------------------------------------------------------------------------------------


@query("src_sql", D("sd", "SELECT kst_date, pos, neg, doc_cnt FROM sd WHERE code = 'L1'"))
def src_sql(spark, d):
    return sentiment_daily(spark, d).where("code = 'L1'").select("kst_date", "pos", "neg", "doc_cnt")


# ---- joins -------------------------------------------------------------------------------------------------------


@query("jn_media", D("sd media", "SELECT channel, count(*) AS n FROM sd JOIN media USING (media_id) GROUP BY channel"))
def jn_media(spark, d):
    return sentiment_daily(spark, d).join(media(spark, d), "media_id").groupBy("channel").agg(F.count("*").alias("n"))


@query("jn_doc_media", D("docs media", "SELECT tier, count(*) AS n FROM docs JOIN media USING (media_id) WHERE is_canonical = 1 AND channel = 'news' GROUP BY tier"))
def jn_doc_media(spark, d):
    return documents(spark, d).where("is_canonical = 1").join(media(spark, d).where("channel = 'news'"), "media_id").groupBy("tier").agg(F.count("*").alias("n"))


@query("jn_body_left", D("docs", "SELECT d.doc_id, left(coalesce(b.text, ''), 600) AS body FROM docs d LEFT JOIN documents b ON b.doc_id = d.doc_id WHERE d.code = 'E2'"))
def jn_body_left(spark, d):
    body = table(spark, d, "documents").select("doc_id", "text")
    return documents(spark, d).where("code = 'E2'").select("doc_id").join(body, "doc_id", "left").select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(600)).alias("body"))


@query("jn_entity_left", D("entities sd", "SELECT e.code, e.name, sum(doc_cnt)::BIGINT AS docs FROM entities e LEFT JOIN sd USING (code) GROUP BY 1, 2 HAVING sum(doc_cnt) > 0"))
def jn_entity_left(spark, d):
    return entities(spark, d).join(sentiment_daily(spark, d), "code", "left").groupBy("code", "name").agg(F.sum("doc_cnt").alias("docs")).where("docs > 0")


@query("jn_cov_left", D("entities cov", "SELECT e.code, max(kst_date) AS last_day, (DATE '2024-02-01' - max(kst_date))::INT AS age FROM entities e LEFT JOIN cov USING (code) GROUP BY 1"))
def jn_cov_left(spark, d):
    x = entities(spark, d).join(coverage(spark, d), "code", "left").groupBy("code").agg(F.max("kst_date").alias("last_day"))
    return x.withColumn("age", F.datediff(F.lit("2024-02-01").cast("date"), "last_day"))


@query("jn_media_doc_left", D("media docs", "SELECT m.media_id, count(DISTINCT d.code) AS codes, count(d.doc_id) AS docs FROM media m LEFT JOIN docs d ON d.media_id = m.media_id AND d.label IS NULL GROUP BY 1"))
def jn_media_doc_left(spark, d):
    return media(spark, d).join(documents(spark, d).where("label IS NULL"), "media_id", "left").groupBy("media_id").agg(F.countDistinct("code").alias("codes"), F.count("doc_id").alias("docs"))


_ASOF = """+ sig AS (SELECT code, signal_date, tier, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(doc_cnt)::BIGINT AS doc_cnt FROM sd JOIN media USING (media_id) GROUP BY 1, 2, 3),
asf AS (SELECT s.*, p.kst_date FROM sig s ASOF JOIN prices p ON s.code = p.code AND s.signal_date <= p.kst_date)"""


@query("jn_asof_fwd", D("sd media prices", f"{_ASOF} SELECT code, signal_date, tier, pos, neg, kst_date FROM asf"))
def jn_asof_fwd(spark, d):
    sig = bt.tier_signal(sentiment_daily(spark, d), media(spark, d))
    return bt.assign_trading_day(sig, prices(spark, d)).select("code", "signal_date", "tier", "pos", "neg", "kst_date")


@query("jn_date_inner", D("sd prices", "SELECT s.code, s.signal_date, sum(pos - neg)::BIGINT AS net FROM sd s JOIN prices p ON p.code = s.code AND p.kst_date = s.signal_date GROUP BY 1, 2"))
def jn_date_inner(spark, d):
    p = prices(spark, d).select("code", F.col("kst_date").alias("signal_date"))
    return sentiment_daily(spark, d).join(p, ["code", "signal_date"]).groupBy("code", "signal_date").agg(F.sum(F.col("pos") - F.col("neg")).alias("net"))


_RAW = f"{_ASOF}, raw AS (SELECT code, kst_date, sum(coalesce(weight, 0) * (pos - neg)) AS raw FROM asf LEFT JOIN weights USING (tier) GROUP BY 1, 2)"


@query("jn_map_lookup", D("sd media prices weights", f"{_RAW} SELECT p.code, p.kst_date, {plain_sql('round(coalesce(raw, 0), 6)')} AS raw FROM prices p LEFT JOIN raw r ON r.code = p.code AND r.kst_date = p.kst_date"))
def jn_map_lookup(spark, d):
    p = prices(spark, d)
    raw = bt.weighted_signal(bt.assign_trading_day(bt.tier_signal(sentiment_daily(spark, d), media(spark, d)), p))
    return p.select("code", "kst_date").join(raw, ["code", "kst_date"], "left").select("code", "kst_date", plain(F.round(F.coalesce("raw", F.lit(0.0)), 6)).alias("raw"))


@query("jn_weights", D("media weights", "SELECT media_id, coalesce(weight, 0.0) AS weight FROM media LEFT JOIN weights USING (tier)"))
def jn_weights(spark, d):
    from tidemark.functions.finance import tier_weight

    return media(spark, d).select("media_id", tier_weight(F.col("tier")).alias("weight"))


@query("jn_semi", D("docs", "SELECT doc_id FROM docs d WHERE is_canonical = 0 AND EXISTS (SELECT 1 FROM docs c WHERE c.code = d.code AND c.dup_group_id = d.dup_group_id AND c.is_canonical = 1 AND c.label IS NOT NULL)"))
def jn_semi(spark, d):
    x = documents(spark, d)
    return x.where("is_canonical = 0").join(x.where("is_canonical = 1 AND label IS NOT NULL").select("code", "dup_group_id"), ["code", "dup_group_id"], "left_semi").select("doc_id")


@query("jn_anti", D("entities prices", "SELECT code FROM entities e WHERE is_active = 1 AND NOT EXISTS (SELECT 1 FROM prices p WHERE p.code = e.code)"))
def jn_anti(spark, d):
    return entities(spark, d).where("is_active = 1").join(prices(spark, d).select("code"), "code", "left_anti").select("code")


_INHERIT = "SELECT d.doc_id, c.label, c.is_relevant, c.confidence, c.prompt_version, 'inherited' AS label_model FROM docs d JOIN (SELECT code, dup_group_id, arg_min(label, doc_id) AS label, arg_min(is_relevant, doc_id) AS is_relevant, arg_min(confidence, doc_id) AS confidence, arg_min(prompt_version, doc_id) AS prompt_version FROM docs WHERE is_canonical = 1 AND label IS NOT NULL GROUP BY 1, 2) c ON c.code = d.code AND c.dup_group_id = d.dup_group_id WHERE d.is_canonical = 0 AND d.label IS NULL"


@query("jn_self_update", D("docs", f"+ i AS ({_INHERIT}) SELECT d.doc_id, coalesce(d.label, i.label) AS label, coalesce(i.label_model, d.label_model) AS label_model FROM docs d LEFT JOIN i ON i.doc_id = d.doc_id"))
def jn_self_update(spark, d):
    x = documents(spark, d)
    i = labels.inherit(x).select("doc_id", F.col("label").alias("l"), F.col("label_model").alias("m"))
    return x.join(i, "doc_id", "left").select("doc_id", F.coalesce("label", "l").alias("label"), F.coalesce("m", "label_model").alias("label_model"))


@query("op_inherit", D("docs", _INHERIT))
def op_inherit(spark, d):
    return labels.inherit(documents(spark, d))


def _with_norm(spark, d):
    return titles(spark, d).select("code", "kst_date", "doc_id", "author", _plain().alias("norm"))


_PAIRS = f"""{_SIM}, n AS (SELECT t.doc_id, t.kst_date, {_PLAIN} AS norm, simhash, u FROM titles t JOIN signed USING (doc_id)),
bk AS (SELECT kst_date, doc_id, 'p' || left(norm, 8) AS bucket FROM n WHERE norm <> '' UNION ALL
  SELECT kst_date, doc_id, 'b:' || k || ':' || ((u >> (16 * k)::INT) & 65535) FROM n, range(0, 4) r(k) WHERE simhash <> 0),
sz AS (SELECT kst_date, bucket FROM bk GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 400),
pairs AS (SELECT DISTINCT x.kst_date, x.doc_id AS a, y.doc_id AS b FROM bk x JOIN bk y ON x.kst_date = y.kst_date AND x.bucket = y.bucket AND x.doc_id < y.doc_id WHERE (x.kst_date, x.bucket) IN (SELECT (kst_date, bucket) FROM sz))"""


@query("jn_pairs", D("titles", f"{_PAIRS} SELECT kst_date, a, b FROM pairs"))
def jn_pairs(spark, d):
    from tidemark.functions.text import simhash64

    return dedup.candidate_pairs(_with_norm(spark, d).withColumn("simhash", simhash64(F.col("norm")))).select("kst_date", "a", "b")


_RULES = (
    ("major", "Alpha", ("ALGERIA", "BRAZIL"), "news"),
    ("blog", "Gamma", ("GERMANY", "EGYPT"), "cafe"),
    ("wire", "Beta", ("BRAZIL", "m3.example.co.kr", "example.co.kr"), "news"),
    ("daily", "delta.example.org", ("Nobody",), "news"),
    ("pr", "Beta", ("IRAQ",), "algo"),
    ("online", "Alpha", ("Nowhere",), "news"),
)


def rules(spark):
    return spark.createDataFrame([(k, t, c, list(a), ch) for k, (t, c, a, ch) in enumerate(_RULES)], "rule int, tier string, canonical string, aliases array<string>, channel string")


_REGDOM = "CASE WHEN len(p) >= 2 THEN array_to_string(p[len(p) - CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'or', 'ne', 'go', 'ac', 'com', 'net', 'org', 'gov', 'edu') THEN 2 ELSE 1 END:], '.') END"
_MATCH = f"""+ rules AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{t}', '{c}', {list(a)}, '{ch}')" for k, (t, c, a, ch) in enumerate(_RULES))}) r(rule, tier, canonical, aliases, channel)),
al AS (SELECT rule, channel, unnest(list_append(aliases, canonical)) AS alias FROM rules),
ad AS (SELECT rule, channel, {_REGDOM} AS dom FROM (SELECT rule, channel, string_split(lower(alias), '.') AS p FROM al)),
md AS (SELECT media_id, channel, {_REGDOM} AS dom FROM (SELECT media_id, channel, string_split(lower(domain), '.') AS p FROM media)),
hit AS (SELECT media_id, min(rule) AS rule FROM (SELECT m.media_id, rule FROM media m JOIN al ON m.name = al.alias AND m.channel IN ('news', al.channel) UNION ALL SELECT md.media_id, rule FROM md JOIN ad ON md.dom = ad.dom AND md.channel IN ('news', ad.channel)) GROUP BY 1)"""


@query("jn_unnest_match", D("media", f"{_MATCH} SELECT media_id, rule FROM hit"))
def jn_unnest_match(spark, d):
    return ledger.match_rules(media(spark, d), rules(spark))


_MERGE = f"""{_MATCH}, one AS (SELECT rule, min(media_id) AS keep, arg_min(domain, media_id) FILTER (WHERE domain IS NOT NULL) AS seen FROM hit JOIN media USING (media_id) GROUP BY 1),
won AS (SELECT canonical, channel, arg_max(keep, rule) AS keep, arg_max(tier, rule) AS tier, arg_max(coalesce(list_filter(list_prepend(canonical, aliases), lambda a: contains(a, '.'))[1], seen), rule) AS domain FROM rules JOIN one USING (rule) GROUP BY 1, 2),
mm AS (SELECT m.media_id, coalesce(w.keep, m.media_id) AS keep, coalesce(w.canonical, m.name) AS name, coalesce(w.tier, m.tier) AS tier, coalesce(w.channel, m.channel) AS channel, coalesce(w.domain, m.domain) AS domain FROM media m LEFT JOIN hit USING (media_id) LEFT JOIN rules r ON r.rule = hit.rule LEFT JOIN won w ON w.canonical = r.canonical AND w.channel = r.channel)"""


@query("op_media_merge", D("sd media", f"{_MERGE} SELECT code, kst_date, signal_date, keep AS media_id, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(doc_cnt)::BIGINT AS doc_cnt FROM sd JOIN mm USING (media_id) GROUP BY 1, 2, 3, 4"))
def op_media_merge(spark, d):
    mapping = ledger.merge_media(media(spark, d), rules(spark))
    return ledger.repoint(sentiment_daily(spark, d), mapping, ["code", "kst_date", "signal_date"], ["pos", "neg", "doc_cnt"])


@query("op_media_merge_outlets", D("media", f"{_MERGE}, lone AS (SELECT canonical, channel, arg_min(tier, rule) AS tier, min(rule) AS rule FROM rules WHERE (canonical, channel) NOT IN (SELECT (canonical, channel) FROM won) AND (canonical, channel) NOT IN (SELECT (name, channel) FROM mm WHERE media_id = keep) GROUP BY 1, 2) SELECT media_id, name, domain, tier, channel FROM mm WHERE media_id = keep UNION ALL SELECT (SELECT max(media_id) FROM media) + row_number() OVER (ORDER BY rule), canonical, CASE WHEN contains(canonical, '.') THEN canonical END, tier, channel FROM lone"))
def op_media_merge_outlets(spark, d):
    return ledger.merged_outlets(media(spark, d), rules(spark))


_OID = "nullif(regexp_extract(url, '/article/(\\d+)/', 1), '')"
_OIDS = f"+ oids AS (SELECT oid, arg_min(name, doc_id) AS name, arg_min(tier, doc_id) AS tier FROM (SELECT doc_id, {_OID} AS oid, name, tier FROM docs JOIN media USING (media_id) WHERE name <> '{PLACEHOLDER}' AND channel = 'news') WHERE oid IS NOT NULL GROUP BY 1)"


@query("agg_oid_index", D("docs media", f"{_OIDS} SELECT oid, name, tier FROM oids"))
def agg_oid_index(spark, d):
    return ledger.oid_index(documents(spark, d), media(spark, d))


_KRDOM = "array_to_string(p[greatest(len(p) - CASE WHEN len(p) >= 3 AND p[-1] = 'kr' AND p[-2] IN ('co', 'or', 'ne', 'go', 'pe', 're') THEN 2 ELSE 1 END, 1):], '.')"
_RECOVER = f"{_OIDS}, un AS (SELECT doc_id, {_OID} AS oid, string_split(regexp_replace(lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')), '^www\\.', ''), '.') AS p FROM docs JOIN media USING (media_id) WHERE name = '{PLACEHOLDER}') SELECT doc_id, coalesce(name, {_KRDOM}) AS outlet, coalesce(tier, 'unknown') AS tier FROM un LEFT JOIN oids USING (oid) WHERE name IS NOT NULL OR p IS NOT NULL"


@query("jn_oid", D("docs media", _RECOVER))
def jn_oid(spark, d):
    return ledger.recover_press(documents(spark, d), media(spark, d))


query("op_recover_press", D("docs media", f"SELECT outlet, tier, count(*) AS n FROM ({D('docs media', _RECOVER)}) GROUP BY 1, 2"))(lambda spark, d: ledger.recover_press(documents(spark, d), media(spark, d)).groupBy("outlet", "tier").agg(F.count("*").alias("n")))


@query("jn_set_and", "SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE IN (SELECT o_orderdate::DATE FROM orders)")
def jn_set_and(spark, d):
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).intersect(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")))


# ---- aggregates --------------------------------------------------------------------------------------------------
_AGG = f"SELECT code, kst_date, {_SIGNAL} AS signal_date, media_id, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neu, count(*) FILTER (WHERE label = -1) AS neg, count(*) FILTER (WHERE is_relevant = 0) AS irrelevant, count(*) AS doc_cnt, sum(is_canonical)::BIGINT AS canonical_cnt, count(*) FILTER (WHERE is_canonical = 0) AS spread_sum FROM docs WHERE published_utc IS NOT NULL GROUP BY 1, 2, 3, 4"


@query("agg_sentiment_daily", D("docs", _AGG))
def agg_sentiment_daily(spark, d):
    return ledger.aggregate_sentiment(documents(spark, d))


@query("agg_tier_rollup", D("sd media", "SELECT code, kst_date, signal_date, tier, channel, sum(pos)::BIGINT AS pos, sum(neu)::BIGINT AS neu, sum(neg)::BIGINT AS neg, sum(doc_cnt)::BIGINT AS doc_cnt FROM sd JOIN media USING (media_id) GROUP BY 1, 2, 3, 4, 5"))
def agg_tier_rollup(spark, d):
    return ledger.tier_rollup(sentiment_daily(spark, d), media(spark, d))


@query("agg_tier_signal", D("sd media", "SELECT code, signal_date, tier, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(doc_cnt)::BIGINT AS doc_cnt FROM sd JOIN media USING (media_id) GROUP BY 1, 2, 3"))
def agg_tier_signal(spark, d):
    return bt.tier_signal(sentiment_daily(spark, d), media(spark, d))


@query("agg_weighted_signal", D("sd media prices weights", f"{_RAW} SELECT code, kst_date, {plain_sql('round(raw, 6)')} AS raw FROM raw"))
def agg_weighted_signal(spark, d):
    return bt.weighted_signal(bt.assign_trading_day(bt.tier_signal(sentiment_daily(spark, d), media(spark, d)), prices(spark, d))).select("code", "kst_date", plain(F.round("raw", 6)).alias("raw"))


_POL = "CASE WHEN pos + neg > 0 THEN (pos - neg) / (pos + neg)::DOUBLE * ((pos + neg) / (pos + neg + 10.0::DOUBLE)) END"
_HEAT = lambda keys: f"CASE WHEN stddev_pop(ln(1 + doc_cnt)) OVER w > 1e-12 THEN (ln(1 + doc_cnt) - avg(ln(1 + doc_cnt)) OVER w) / stddev_pop(ln(1 + doc_cnt)) OVER w ELSE 0 END"


def _series_sql(freq: str, by: str) -> str:
    keys = {"total": "code", "tier": "code, tier", "media": "code, name"}[by]
    bins = {"daily": "kst_date", "weekly": "(kst_date + ((5 - isodow(kst_date) + 7) % 7)::INT)::DATE", "monthly": "last_day(kst_date)"}[freq]
    every = {"daily": "", "weekly": "range(lo, hi + INTERVAL 1 DAY, INTERVAL 7 DAY)", "monthly": "list_transform(range(date_trunc('month', lo), hi + INTERVAL 1 DAY, INTERVAL 1 MONTH), lambda m: last_day(m))"}[freq]
    whole = "SELECT DISTINCT code, bin FROM got" if freq == "daily" else f"SELECT code, unnest({every})::DATE AS bin FROM (SELECT code, min(bin) AS lo, max(bin) AS hi FROM got GROUP BY 1)"
    body = f"""+ got AS (SELECT {keys}, {bins} AS bin, sum(pos)::BIGINT AS pos, sum(neu)::BIGINT AS neu, sum(neg)::BIGINT AS neg, sum(doc_cnt)::BIGINT AS doc_cnt FROM sd JOIN media USING (media_id) GROUP BY ALL),
bins AS (SELECT * FROM ({whole}) JOIN (SELECT DISTINCT {keys} FROM got) USING (code)),
f AS (SELECT {keys}, bin, coalesce(pos, 0) AS pos, coalesce(neu, 0) AS neu, coalesce(neg, 0) AS neg, coalesce(doc_cnt, 0) AS doc_cnt FROM bins LEFT JOIN got USING ({keys}, bin))
SELECT {keys}, bin, pos, neu, neg, doc_cnt, round({_POL}, 8) AS polarity{f", round({_HEAT(keys)}, 7) AS heat" if by == "total" else ""} FROM f WINDOW w AS (PARTITION BY {keys})"""
    return D("sd media", body)


def _series(spark, d, freq: str, by: str):
    x = series.sentiment_series(sentiment_daily(spark, d), media(spark, d), freq, by)
    return x.withColumns({c: F.round(c, k) for c, k in (("polarity", 8), ("heat", 7)) if c in x.columns})


for _name, _f, _b in (("agg_sentiment_series", "daily", "total"), ("agg_sentiment_series_tier", "daily", "tier"), ("agg_resample_sum", "monthly", "total"), ("agg_sentiment_series_media", "weekly", "media"), ("win_zscore", "weekly", "total")):
    query(_name, _series_sql(_f, _b))(lambda spark, d, f=_f, b=_b: _series(spark, d, f, b))


def _ohlc_sql(bins: str) -> str:
    return D("prices", f"SELECT code, {bins} AS bin, arg_min(open, kst_date) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low, arg_max(close, kst_date) FILTER (WHERE close IS NOT NULL) AS close, sum(volume)::BIGINT AS volume FROM prices GROUP BY 1, 2")


query("agg_resample_ohlc", _ohlc_sql("(kst_date + ((5 - isodow(kst_date) + 7) % 7)::INT)::DATE"))(lambda spark, d: series.resample_ohlc(prices(spark, d), "weekly"))
query("agg_resample_ohlc_monthly", _ohlc_sql("last_day(kst_date)"))(lambda spark, d: series.resample_ohlc(prices(spark, d), "monthly"))

_TEMP = f"+ ef AS (SELECT code, signal_date AS kst_date, {_POL} AS temp, (pos - neg)::DOUBLE AS net, n FROM (SELECT code, signal_date, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(doc_cnt)::BIGINT AS n FROM sd GROUP BY 1, 2)), rt AS (SELECT code, kst_date, close / lag(close) OVER (PARTITION BY code ORDER BY kst_date) - 1 AS ret FROM prices), fr AS (SELECT ef.*, ret FROM ef JOIN rt USING (code, kst_date)), wk AS (SELECT code, (kst_date + (7 - isodow(kst_date))::INT)::DATE AS bin, avg(temp) AS temp FROM fr GROUP BY 1, 2)"


@query("agg_resample_mean", D("sd prices", f"{_TEMP}, span AS (SELECT code, min(bin) AS lo, max(bin) AS hi FROM wk GROUP BY 1), bins AS (SELECT code, unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 7 DAY))::DATE AS bin FROM span) SELECT code, bin, round(temp, 8) AS temp FROM bins LEFT JOIN wk USING (code, bin)"))
def agg_resample_mean(spark, d):
    return series.resample_mean(stats.entity_frame(sentiment_daily(spark, d), prices(spark, d)), ["code"], "temp", "W", "kst_date").withColumn("temp", F.round("temp", 8))


_CATALOG = "SELECT code, media_id, name, tier, docs FROM (SELECT code, media_id, sum(doc_cnt)::BIGINT AS docs, row_number() OVER (PARTITION BY code ORDER BY sum(doc_cnt) DESC, media_id) AS rn FROM sd GROUP BY 1, 2) JOIN media USING (media_id) WHERE rn <= {n}"
query("agg_media_catalog", D("sd media", _CATALOG.format(n=60)))(lambda spark, d: series.media_catalog(sentiment_daily(spark, d), media(spark, d)))
query("top_media", D("sd media", _CATALOG.format(n=5)))(lambda spark, d: series.media_catalog(sentiment_daily(spark, d), media(spark, d), 5))


@query("agg_stocks", D("entities sd", "SELECT code, name, count(DISTINCT kst_date) AS days, sum(doc_cnt)::BIGINT AS docs, min(kst_date) AS first_day, max(kst_date) AS last_day FROM entities JOIN sd USING (code) GROUP BY 1, 2"))
def agg_stocks(spark, d):
    from tidemark.plans.api import stocks

    return stocks(entities(spark, d), sentiment_daily(spark, d))


@query("agg_tiers", D("sd media weights", "SELECT w.tier, weight, coalesce(docs, 0)::BIGINT AS docs FROM weights w LEFT JOIN (SELECT tier, sum(doc_cnt) AS docs FROM sd JOIN media USING (media_id) GROUP BY 1) USING (tier)"))
def agg_tiers(spark, d):
    from tidemark.plans.api import tiers

    return tiers(sentiment_daily(spark, d), media(spark, d))


@query("agg_mapping_progress", D("sd media", "SELECT sum(doc_cnt) FILTER (WHERE tier = 'unknown')::BIGINT AS unknown_docs, sum(doc_cnt)::BIGINT AS total_docs, round(100.0::DOUBLE * sum(doc_cnt) FILTER (WHERE tier = 'unknown') / sum(doc_cnt), 1) AS unknown_pct, (SELECT count(*) FROM media WHERE channel = 'news' AND tier <> 'unknown') AS mapped, (SELECT count(*) FROM media WHERE channel = 'news') AS outlets FROM sd JOIN media USING (media_id) WHERE channel = 'news'"))
def agg_mapping_progress(spark, d):
    from tidemark.plans.api import mapping_progress

    return mapping_progress(sentiment_daily(spark, d), media(spark, d))


@query("agg_label_coverage", D("docs media", "SELECT code, count(*) AS canonical, count(label) AS labeled, round(count(label) / count(*), 9) AS ratio FROM docs JOIN media USING (media_id) WHERE is_canonical = 1 AND channel NOT IN ('vendor', 'algo', 'pr', 'aggregator') GROUP BY 1"))
def agg_label_coverage(spark, d):
    return ledger.label_coverage(documents(spark, d), media(spark, d)).withColumn("ratio", F.round("ratio", 9))


_EXACT = f"SELECT doc_id, left(h, 12) AS dup_group_id, (doc_id = min(doc_id) OVER w)::INT AS is_canonical FROM (SELECT doc_id, kst_date, sha1({_PLAIN}) AS h FROM titles) WINDOW w AS (PARTITION BY kst_date, h) QUALIFY count(*) OVER w > 1"


@query("op_dup_exact", D("titles", _EXACT))
def op_dup_exact(spark, d):
    from tidemark.functions.text import title_hash

    return dedup.exact(_with_norm(spark, d).withColumn("title_hash", title_hash(F.col("norm"))))


@query("agg_dup_exact", D("titles", f"SELECT kst_date, h AS title_hash, count(*) AS n, min(doc_id) AS keep, count(*) - 1 AS demoted FROM (SELECT doc_id, kst_date, sha1({_PLAIN}) AS h FROM titles) GROUP BY 1, 2 HAVING count(*) > 1"))
def agg_dup_exact(spark, d):
    from tidemark.functions.text import title_hash

    x = _with_norm(spark, d).groupBy("kst_date", title_hash(F.col("norm")).alias("title_hash"))
    return x.agg(F.count("*").alias("n"), F.min("doc_id").alias("keep")).where("n > 1").withColumn("demoted", F.col("n") - 1)


@query("agg_cov_status", D("cov", "SELECT code, source, status, count(*) AS days, min(kst_date) AS first_day, max(kst_date) AS last_day, sum(doc_count)::BIGINT AS docs FROM cov GROUP BY 1, 2, 3"))
def agg_cov_status(spark, d):
    return coverage(spark, d).groupBy("code", "source", "status").agg(F.count("*").alias("days"), F.min("kst_date").alias("first_day"), F.max("kst_date").alias("last_day"), F.sum("doc_count").alias("docs"))


@query("agg_doc_status", D("docs", "SELECT code, count(*) AS total, count(label) AS labelled, count(*) FILTER (WHERE is_canonical = 0) AS dup FROM docs GROUP BY 1"))
def agg_doc_status(spark, d):
    return documents(spark, d).groupBy("code").agg(F.count("*").alias("total"), F.count("label").alias("labelled"), F.count_if(F.col("is_canonical") == 0).alias("dup"))


@query("agg_prompt_versions", D("docs", "SELECT DISTINCT prompt_version FROM docs WHERE label_model <> 'inherited' AND prompt_version IS NOT NULL"))
def agg_prompt_versions(spark, d):
    return documents(spark, d).where("label_model <> 'inherited' AND prompt_version IS NOT NULL").select("prompt_version").distinct()


@query("agg_pending_estimate", D("docs media", "SELECT channel, channel NOT IN ('vendor', 'algo', 'pr', 'aggregator') AS target, count(*) AS n, ceil(count(*) / 15.0)::BIGINT AS calls FROM docs JOIN media USING (media_id) WHERE label IS NULL AND is_canonical = 1 GROUP BY 1"))
def agg_pending_estimate(spark, d):
    from tidemark.schema import NON_OPINION_CHANNELS, SCORE_BATCH

    x = documents(spark, d).where("label IS NULL AND is_canonical = 1").join(media(spark, d), "media_id").groupBy("channel").agg(F.count("*").alias("n"))
    return x.select("channel", (~F.col("channel").isin(*NON_OPINION_CHANNELS)).alias("target"), "n", F.ceil(F.col("n") / SCORE_BATCH).alias("calls"))


@query("agg_cov_backfill", D("docs", "SELECT code, source, kst_date, 'completed' AS status, count(*) AS doc_count FROM docs WHERE kst_date IS NOT NULL GROUP BY 1, 2, 3"))
def agg_cov_backfill(spark, d):
    return documents(spark, d).where("kst_date IS NOT NULL").groupBy("code", "source", "kst_date").agg(F.lit("completed").alias("status"), F.count("*").alias("doc_count"))


@query("agg_dashboard", D("entities prices docs", "SELECT code, coalesce(p, 0) AS price_days, coalesce(n, 0) AS docs, coalesce(pct, 0) AS label_pct FROM entities LEFT JOIN (SELECT code, count(*) AS p FROM prices GROUP BY 1) USING (code) LEFT JOIN (SELECT code, count(*) AS n, round(100.0::DOUBLE * count(label) / count(*), 1) AS pct FROM docs GROUP BY 1) USING (code)"))
def agg_dashboard(spark, d):
    p = prices(spark, d).groupBy("code").agg(F.count("*").alias("p"))
    n = documents(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.round(100.0 * F.count("label") / F.count("*"), 1).alias("pct"))
    zero = F.lit(0)
    return entities(spark, d).join(p, "code", "left").join(n, "code", "left").select("code", F.coalesce("p", zero).alias("price_days"), F.coalesce("n", zero).alias("docs"), F.coalesce("pct", F.lit(0.0)).alias("label_pct"))


# ---- windows -----------------------------------------------------------------------------------------------------
_CAP = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY code, kst_date ORDER BY (channel IN ('community', 'cafe'))::INT, CASE WHEN channel NOT IN ('community', 'cafe') THEN CASE tier WHEN 'major' THEN 0 WHEN 'daily' THEN 1 WHEN 'online' THEN 2 WHEN 'unknown' THEN 3 WHEN 'blog' THEN 4 ELSE 5 END END NULLS FIRST, coalesce(engagement, -1) DESC, doc_id) AS rn FROM {src}) WHERE rn <= 20"


@query("win_daily_cap", D("docs media", _CAP.format(src="docs JOIN media USING (media_id)")))
def win_daily_cap(spark, d):
    return labels.daily_cap(documents(spark, d).join(media(spark, d), "media_id"), 20).select("doc_id")


_PENDING = "(SELECT * FROM docs JOIN media USING (media_id) WHERE label IS NULL AND is_canonical = 1 AND (channel NOT IN ('community', 'cafe') OR engagement IS NULL OR engagement >= 20) AND channel NOT IN ('vendor', 'algo', 'pr', 'aggregator'))"
query("op_pending", D("docs media", _CAP.format(src=_PENDING)))(lambda spark, d: labels.pending(documents(spark, d), media(spark, d), cap=20).select("doc_id"))
query("limit_pending", D("docs media", f"SELECT doc_id FROM {_PENDING} ORDER BY published_utc DESC NULLS LAST, doc_id DESC LIMIT 25"))(lambda spark, d: labels.pending(documents(spark, d), media(spark, d), limit=25).select("doc_id"))


@query("win_author_cap", D("docs", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY code, kst_date, author ORDER BY doc_id) AS rn FROM docs WHERE author IS NOT NULL AND author <> '') WHERE rn > 3"))
def win_author_cap(spark, d):
    return dedup.spam(documents(spark, d))


query("op_spam", D("docs", "SELECT doc_id, (is_canonical = 1 AND NOT (author IS NOT NULL AND author <> '' AND row_number() OVER (PARTITION BY code, kst_date, author ORDER BY doc_id) > 3))::INT AS is_canonical FROM docs"))(
    lambda spark, d: documents(spark, d).join(dedup.spam(documents(spark, d)).withColumn("s", F.lit(1)), "doc_id", "left").select("doc_id", ((F.col("is_canonical") == 1) & F.col("s").isNull()).cast("int").alias("is_canonical"))
)


@query("win_pct_change", D("prices", "SELECT code, kst_date, round(close / lag(close) OVER (PARTITION BY code ORDER BY kst_date) - 1, 8) AS ret FROM prices"))
def win_pct_change(spark, d):
    return stats.returns(prices(spark, d)).select("code", "kst_date", F.round("ret", 8).alias("ret"))


@query("win_ma20", D("sd", "SELECT code, kst_date, round(CASE WHEN count(p) OVER w >= 10 THEN avg(p) OVER w END, 8) AS ma FROM (SELECT code, kst_date, CASE WHEN sum(pos + neg) > 3 THEN (sum(pos) - sum(neg)) / sum(pos + neg)::DOUBLE END AS p FROM sd GROUP BY 1, 2) WINDOW w AS (PARTITION BY code ORDER BY kst_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def win_ma20(spark, d):
    n = F.sum(F.col("pos") + F.col("neg"))
    x = sentiment_daily(spark, d).groupBy("code", "kst_date").agg(F.when(n > 3, (F.sum("pos") - F.sum("neg")) / n).alias("p"))
    return x.select("code", "kst_date", F.round(series.moving_average(F.col("p"), Window.partitionBy("code").orderBy("kst_date")), 8).alias("ma"))


@query("win_ma20_full", D("prices", "SELECT code, kst_date, round(avg(close) OVER (PARTITION BY code ORDER BY kst_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS ma FROM prices"))
def win_ma20_full(spark, d):
    return prices(spark, d).select("code", "kst_date", F.round(series.moving_average(F.col("close"), Window.partitionBy("code").orderBy("kst_date"), least=1), 4).alias("ma"))


_GAPS = "+ s AS (SELECT DISTINCT code || '-' || media_id AS code, kst_date FROM sd), p AS (SELECT DISTINCT prices.code || '-' || media_id AS code, prices.kst_date FROM prices JOIN (SELECT DISTINCT code, media_id FROM sd) o ON o.code = prices.code), x AS (SELECT p.code, p.kst_date, s.kst_date IS NOT NULL AS has, sum((s.kst_date IS NOT NULL)::INT) OVER (PARTITION BY p.code ORDER BY p.kst_date) AS island, lead(p.kst_date) OVER (PARTITION BY p.code ORDER BY p.kst_date) AS nxt FROM p LEFT JOIN s ON s.code = p.code AND s.kst_date = p.kst_date) SELECT code, min(kst_date) AS gap_start, coalesce(arg_max_null(nxt, kst_date), max(kst_date)) AS gap_end, count(*) AS days FROM x WHERE NOT has GROUP BY code, island"


@query("win_gaps_islands", D("sd prices", _GAPS))
def win_gaps_islands(spark, d):
    """Gaps of each outlet's coverage of a code."""
    sd, own = sentiment_daily(spark, d), F.concat_ws("-", "code", "media_id").alias("code")
    days = prices(spark, d).select("code", "kst_date").join(sd.select("code", "media_id").distinct(), "code").select(own, "kst_date")
    return series.coverage_gaps(days, sd.select(own, "kst_date"))


@query("win_contiguous", D("prices", "SELECT code, min(kst_date) AS run_start, max(kst_date) AS run_end, count(*) AS days FROM (SELECT code, kst_date, kst_date - (row_number() OVER (PARTITION BY code ORDER BY kst_date))::INT AS anchor FROM prices) GROUP BY code, anchor"))
def win_contiguous(spark, d):
    return series.contiguous_runs(prices(spark, d), ["code"])


@query("win_new_month", D("prices", "SELECT code, kst_date FROM prices QUALIFY coalesce(date_trunc('month', kst_date) <> date_trunc('month', lag(kst_date) OVER (PARTITION BY code ORDER BY kst_date)), true)"))
def win_new_month(spark, d):
    return bt.dca(prices(spark, d)).where("buys > 0").select("code", "kst_date")


_JUMP = "SELECT code, kst_date, round(abs(close / was - 1), 8) AS jump, CASE WHEN abs(close / was - 1) >= 0.3 THEN 'FAIL' WHEN abs(close / was - 1) >= 0.15 THEN 'WARN' ELSE 'OK' END AS level FROM (SELECT *, lag(close) OVER w AS was, lag(source) OVER w AS before FROM prices WINDOW w AS (PARTITION BY code ORDER BY kst_date)) WHERE before <> source"
for _n in ("win_boundary", "agg_source_jump"):
    query(_n, D("prices", _JUMP))(lambda spark, d: __import__("tidemark.operators.health", fromlist=["x"]).source_jumps(prices(spark, d)).withColumn("jump", F.round("jump", 8)))

# ---- limits, sets ------------------------------------------------------------------------------------------------


@query("top_fee", "SELECT max(o_orderdate)::DATE AS effective_from, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS buy_bps FROM orders")
def top_fee(spark, d):
    o = table(spark, d, "orders")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(1).select(F.to_date("o_orderdate").alias("effective_from"), F.col("o_totalprice").alias("buy_bps"))


@query("top_close", D("prices", "SELECT code, round(arg_max(close, kst_date))::BIGINT AS point_value FROM prices GROUP BY 1"))
def top_close(spark, d):
    return prices(spark, d).groupBy("code").agg(F.round(F.max_by("close", "kst_date")).cast("long").alias("point_value"))


@query("top_runs", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def top_runs(spark, d):
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(8).select("event_id", "event_type")


@query("top_threads", D("titles", "SELECT doc_id FROM titles WHERE contains(lower(title), 'th') ORDER BY length(title) DESC, doc_id LIMIT 60"))
def top_threads(spark, d):
    from tidemark.functions.text import any_term

    return titles(spark, d).where(any_term(F.col("title"), ("th",))).orderBy(F.length("title").desc(), "doc_id").limit(60).select("doc_id")


@query("set_distinct_incomplete", D("cov", "SELECT DISTINCT code, kst_date FROM cov WHERE status IN ('partial', 'failed')"))
def set_distinct_incomplete(spark, d):
    return ledger.incomplete_dates(coverage(spark, d))


@query("set_union_dates", "SELECT l_shipdate::DATE AS day FROM lineitem UNION SELECT o_orderdate::DATE FROM orders")
def set_union_dates(spark, d):
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).union(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))).distinct()


@query("set_in_coverage_days", "SELECT o_orderkey, unnest(range(o_orderdate, o_orderdate + INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE AS day FROM orders")
def set_in_coverage_days(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(day, F.date_add(day, 2))).alias("day"))


# ---- table maintenance -------------------------------------------------------------------------------------------
@query("sink_insert_ignore", D("docs", "SELECT doc_id FROM (SELECT doc_id, url, row_number() OVER (PARTITION BY code, source, url ORDER BY doc_id) AS rn FROM docs) WHERE url IS NULL OR rn = 1"))
def sink_insert_ignore(spark, d):
    return ledger.insert_documents(documents(spark, d)).select("doc_id")


@query("sink_url_seen", D("docs", "SELECT doc_id FROM docs n WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.doc_id % 2 = 0 AND o.code = n.code AND o.source = n.source AND o.url = n.url)"))
def sink_url_seen(spark, d):
    x = documents(spark, d)
    return ledger.unseen(x.where("doc_id % 2 = 1"), x.where("doc_id % 2 = 0")).select("doc_id")


@query("sink_upsert_price", D("prices", "SELECT code, kst_date, CASE WHEN month(kst_date) = 6 THEN close * 2 ELSE close END AS close FROM prices"))
def sink_upsert_price(spark, d):
    p = prices(spark, d).select("code", "kst_date", "close")
    return ledger.upsert(p, p.where("month(kst_date) = 6").withColumn("close", F.col("close") * 2), ["code", "kst_date"])


@query("sink_purge_stale", D("prices", "SELECT code, count(*) AS n, min(kst_date) AS first_day FROM prices WHERE source = 'b' OR month(kst_date) = 1 GROUP BY 1"))
def sink_purge_stale(spark, d):
    p = prices(spark, d).withColumn("source", F.when((F.month("kst_date") == 1) & (F.col("source") == "a"), F.lit(None)).otherwise(F.col("source")))
    return ledger.purge_stale(p, "b").groupBy("code").agg(F.count("*").alias("n"), F.min("kst_date").alias("first_day"))


_COV = """+ rk AS (SELECT *, CASE status WHEN 'completed' THEN 1 WHEN 'partial' THEN 2 WHEN 'failed' THEN 3 ELSE 0 END AS r FROM cov),
runs AS (SELECT code, source, kst_date, run, arg_max(status, (r, -seq)) AS status, sum(doc_count)::BIGINT AS doc_count FROM rk GROUP BY 1, 2, 3, 4),
fin AS (SELECT code, source, kst_date, arg_max(status, run) AS status, arg_max(doc_count, run) AS doc_count FROM runs GROUP BY 1, 2, 3),
tr AS (SELECT code, source, kst_date, count(*) AS attempts, arg_max(last_cursor, seq) FILTER (WHERE last_cursor IS NOT NULL) AS last_cursor FROM cov GROUP BY 1, 2, 3)"""
for _n in ("op_cov_merge", "sink_cov_upsert"):
    query(_n, D("cov", f"{_COV} SELECT code, source, kst_date, status, doc_count, attempts, last_cursor FROM fin JOIN tr USING (code, source, kst_date)"))(lambda spark, d: ledger.merge_coverage(coverage(spark, d)))


@query("set_missing_dates", D("cov", f"{_COV}, c AS (SELECT code, source, unnest(range(min(kst_date), max(kst_date) + INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE AS kst_date FROM cov GROUP BY 1, 2) SELECT code, source, kst_date FROM c WHERE (code, source, kst_date) NOT IN (SELECT (code, source, kst_date) FROM fin WHERE status IN ('completed', 'empty'))"))
def set_missing_dates(spark, d):
    cov = coverage(spark, d)
    span = cov.groupBy("code", "source").agg(F.min("kst_date").alias("lo"), F.date_add(F.max("kst_date"), 2).alias("hi"))
    return series.missing_dates(span, ledger.merge_coverage(cov).where(F.col("status").isin("completed", "empty")), ["code", "source"])


@query("agg_incomplete_ratio", D("cov", f"{_COV}, x AS (SELECT code, source, count(*) FILTER (WHERE status IN ('partial', 'failed')) AS bad, count(*) FILTER (WHERE status <> 'pending') AS total FROM fin GROUP BY 1, 2) SELECT code, source, total, round(bad / total, 8) AS ratio, CASE WHEN bad / total >= 0.2 THEN 'WARN' ELSE 'OK' END AS level FROM x WHERE total >= 20"))
def agg_incomplete_ratio(spark, d):
    from tidemark.operators.health import incomplete

    return incomplete(ledger.merge_coverage(coverage(spark, d)), least=20).withColumn("ratio", F.round("ratio", 8))


@query("sink_get_or_create", D("media", "+ nn AS (SELECT DISTINCT s_name AS name, 'news' AS channel FROM supplier UNION SELECT name, channel FROM media), new AS (SELECT name, channel, row_number() OVER (ORDER BY name, channel) AS rn FROM nn WHERE (name, channel) NOT IN (SELECT (name, channel) FROM media)) SELECT media_id, name, tier, channel FROM media UNION ALL SELECT (SELECT max(media_id) FROM media) + rn, name, 'unknown', channel FROM new"))
def sink_get_or_create(spark, d):
    m = media(spark, d)
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("news").alias("channel")).union(m.select("name", "channel"))
    return ledger.get_or_create_media(m, names).select("media_id", "name", "tier", "channel")


@query("sink_delete_insert", D("sd", "SELECT code, year(kst_date) AS y, sum(CASE WHEN year(kst_date) = 1997 THEN doc_cnt * 2 ELSE doc_cnt END)::BIGINT AS docs FROM sd GROUP BY 1, 2"))
def sink_delete_insert(spark, d):
    x = sentiment_daily(spark, d)
    new = x.where("year(kst_date) = 1997").withColumn("doc_cnt", F.col("doc_cnt") * 2)
    return ledger.replace_partitions(x, new, ["code", "kst_date"]).groupBy("code", F.year("kst_date").alias("y")).agg(F.sum("doc_cnt").alias("docs"))


@query("sink_ttl_delete", D("docs", "SELECT b.doc_id FROM documents b WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = b.doc_id AND d.label IS NOT NULL)"))
def sink_ttl_delete(spark, d):
    return ledger.without_labelled_bodies(table(spark, d, "documents").select("doc_id"), documents(spark, d))


@query("sink_seed_upsert", D("entities", "SELECT code, CASE WHEN code < 'E3' THEN 'renamed' ELSE name END AS name, CASE WHEN code < 'E3' THEN 1 ELSE is_active END AS is_active FROM entities"))
def sink_seed_upsert(spark, d):
    e = entities(spark, d)
    seed = e.where("code < 'E3'").withColumns({"name": F.lit("renamed"), "is_active": F.lit(1)})
    return ledger.upsert(e, seed, ["code"]).select("code", "name", "is_active")


@query("sink_json", D("prices", "SELECT code, strftime(kst_date, '%Y-%m-%d') AS day, close FROM prices"))
def sink_json(spark, d):
    rows = prices(spark, d).select(F.to_json(F.struct("code", "kst_date", "close")).alias("line"))
    return rows.select(F.from_json("line", "code string, kst_date string, close double").alias("r")).select("r.code", F.col("r.kst_date").alias("day"), "r.close")


def _scratch(spark, name: str) -> str:
    import uuid

    from tidemark.operators.ledger import work_dir

    return f"{work_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


@query("sink_delete_insert_files", D("sd", "SELECT code, year(kst_date) AS y, sum(CASE WHEN year(kst_date) = 1997 THEN doc_cnt * 2 ELSE doc_cnt END)::BIGINT AS docs FROM sd GROUP BY 1, 2"))
def sink_delete_insert_files(spark, d):
    """The same replacement in files: only the folders of the new rows are written again."""
    path, x = _scratch(spark, "daily"), sentiment_daily(spark, d).withColumn("y", F.year("kst_date"))
    ledger.write_partitions(x, path, ["code", "y"])
    ledger.write_partitions(x.where("y = 1997").withColumn("doc_cnt", F.col("doc_cnt") * 2), path, ["code", "y"])
    return spark.read.schema(x.schema).parquet(path).groupBy("code", "y").agg(F.sum("doc_cnt").alias("docs"))


@query("sink_snapshot", D("sd media", "SELECT 'media' AS name, count(*) AS n FROM media UNION ALL SELECT 'sentiment_daily', count(*) FROM sd"))
def sink_snapshot(spark, d):
    counts = ledger.snapshot(spark, {"media": media(spark, d), "sentiment_daily": sentiment_daily(spark, d)}, _scratch(spark, "snapshot"))
    return spark.createDataFrame(sorted(counts.items()), "name string, n long")


@query("sink_runlog", "SELECT * FROM (VALUES ('daily', 'done', 3::BIGINT), ('daily', 'failed', 1), ('daily', 'running', 4)) r(stage, status, n)")
def sink_runlog(spark, d):
    """Four runs of a stage, one of which fails."""
    path = _scratch(spark, "runs")
    for k in range(4):
        try:
            with ledger.RunLog(spark, path, "daily") as log:
                if k == 2:
                    raise ValueError("no answer")
                log.finish({"docs": k})
        except ValueError:
            pass
    return spark.read.parquet(path).groupBy("stage", "status").agg(F.count("*").alias("n"))


# ---- near-duplicates ---------------------------------------------------------------------------------------------
@query("op_near_dedup")
def op_near_dedup(spark, d):
    return dedup.near_dedup(_with_norm(spark, d))
