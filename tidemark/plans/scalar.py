"""Queries on filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import finance as fin
from tidemark.functions import text as tx
from tidemark.plans.proxies import documents, media, prices, sentiment_daily, table, titles, with_
from tidemark.plans.registry import query
from tidemark.schema import COMMUNITY_MIN_ENGAGEMENT, FEES

D = with_


@query("flt_offtopic", D("titles", "SELECT doc_id FROM titles WHERE contains(replace(replace(title, 'the', ' '), 'der', ' '), 'er') OR contains(replace(replace(title, 'the', ' '), 'der', ' '), 'an')"))
def flt_offtopic(spark, d):
    lists = [F.array(*[F.lit(x) for x in xs]) for xs in (("er", "an"), ("the", "der"))]
    return titles(spark, d).where(tx.keeps_topic(F.col("title"), *lists)).select("doc_id")


@query("flt_terms", D("titles", "SELECT doc_id FROM titles WHERE length(title) >= 12 AND (contains(lower(title), 'tion') OR contains(lower(title), 'eau'))"))
def flt_terms(spark, d):
    return titles(spark, d).where((F.length("title") >= 12) & tx.any_term(F.col("title"), ("Tion", "EAU"))).select("doc_id")


@query("flt_fffd", "SELECT doc_id, (length(t) - length(replace(t, chr(65533), '')))::INT AS bad FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(65533) ELSE text END AS t FROM documents) WHERE contains(t, chr(65533))")
def flt_fffd(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(tx.REPLACEMENT))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.bad_chars(t).cast("int").alias("bad")).where("bad > 0")


@query("flt_hangul", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' 주가' ELSE text END AS t FROM documents) WHERE regexp_matches(t, '[가-힣]')")
def flt_hangul(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 주가"))).otherwise(F.col("text"))
    return table(spark, d, "documents").where(tx.has_hangul(t)).select("doc_id")


@query("flt_isin", D("docs", "SELECT source, count(*) AS n FROM docs WHERE code IN ('E1', 'E3') GROUP BY source"))
def flt_isin(spark, d):
    return documents(spark, d).where(F.col("code").isin("E1", "E3")).groupBy("source").agg(F.count("*").alias("n"))


@query("flt_not_like", D("docs", "SELECT count(*) FILTER (WHERE url LIKE '%/article/%') AS articles, count(*) FILTER (WHERE NOT (url LIKE '%/x')) AS others FROM docs"))
def flt_not_like(spark, d):
    u = F.col("url")
    return documents(spark, d).agg(F.count_if(u.like("%/article/%")).alias("articles"), F.count_if(~u.like("%/x")).alias("others"))


def _range(rng: str) -> str:
    lo = {"3m": "max(kst_date) - 90", "6m": "max(kst_date) - 180", "1y": "max(kst_date) - 365"}.get(rng)
    bounds = f"SELECT code, ({lo})::DATE AS lo, max(kst_date) AS hi FROM prices GROUP BY code" if lo else "SELECT code, (min(kst_date) - 10)::DATE AS lo, (max(kst_date) + 5)::DATE AS hi FROM sd GROUP BY code"
    return D("sd prices", f"SELECT code, count(*) AS days, min(kst_date) AS first_day FROM prices JOIN ({bounds}) b USING (code) WHERE kst_date BETWEEN lo AND hi GROUP BY code")


def clip(spark, d, rng: str):
    from tidemark.operators.series import clip_range

    return clip_range(prices(spark, d), sentiment_daily(spark, d), rng).groupBy("code").agg(F.count("*").alias("days"), F.min("kst_date").alias("first_day"))


query("flt_range_all", D("prices", "SELECT code, count(*) AS days, min(kst_date) AS first_day FROM prices GROUP BY code"))(lambda spark, d: clip(spark, d, "all"))
for _r in ("data", "3m", "6m", "1y"):
    query(f"flt_range_{_r}", _range(_r))(lambda spark, d, r=_r: clip(spark, d, r))


@query("flt_since", D("docs", "SELECT count(*) AS n FROM docs WHERE published_utc >= date_trunc('day', (SELECT max(published_utc) FROM docs)) - INTERVAL 7 DAY"))
def flt_since(spark, d):
    x = documents(spark, d)
    last = x.agg(F.date_trunc("day", F.max("published_utc")).alias("last"))  # one row
    return x.join(F.broadcast(last), F.col("published_utc") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).agg(F.count("*").alias("n"))


@query("flt_engagement", D("docs media", "SELECT count(*) AS n FROM docs JOIN media USING (media_id) WHERE channel NOT IN ('community', 'cafe') OR engagement IS NULL OR engagement >= 20"))
def flt_engagement(spark, d):
    from tidemark.operators.labels import engaged

    return documents(spark, d).join(media(spark, d), "media_id").where(engaged(COMMUNITY_MIN_ENGAGEMENT)).agg(F.count("*").alias("n"))


@query("prj_parse_weights", D("media", "SELECT media_id, CASE tier WHEN 'major' THEN 7.5 WHEN 'blog' THEN 0.0 ELSE weight END AS weight FROM media LEFT JOIN (SELECT * FROM (VALUES ('daily', 2.0::DOUBLE), ('online', 1.0), ('wire', 4.0), ('global', 2.0), ('crypto', 1.0), ('unknown', 1.0), ('vendor', 0.0), ('algo', 0.0), ('pr', 0.0), ('community', 0.0)) w(tier, weight)) USING (tier)"))
def prj_parse_weights(spark, d):
    return media(spark, d).select("media_id", fin.tier_weight(F.col("tier"), fin.parse_weights("major:7.5, blog:0,skipped")).alias("weight"))


@query("prj_case_rank", D("media", "SELECT tier, CASE tier WHEN 'major' THEN 0 WHEN 'daily' THEN 1 WHEN 'online' THEN 2 WHEN 'unknown' THEN 3 WHEN 'blog' THEN 4 ELSE 5 END AS rank FROM media"))
def prj_case_rank(spark, d):
    from tidemark.operators.labels import tier_rank

    return media(spark, d).select("tier", tier_rank(F.col("tier")).alias("rank"))


@query("prj_label_map", "SELECT event_id AS doc_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS label, left(event_type || ' because', 10) AS why, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS is_relevant, CASE WHEN event_id % 6 = 0 THEN 0.0::DOUBLE ELSE 0.5 END AS confidence FROM events WHERE event_type IN ('purchase', 'error', 'view') AND event_id % 2 = 0")
def prj_label_map(spark, d):
    from tidemark.operators.labels import read_labels

    word = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "view", "neutral").otherwise("unsure")
    e = table(spark, d, "events")
    i = F.col("event_id")
    said = F.struct(i.cast("string").alias("id"), F.concat(F.lit(" "), F.upper(word)).alias("label"), F.when(i % 4 == 0, "false").otherwise("true").alias("relevant"), F.when(i % 6 == 0, "sure").otherwise("0.5").alias("confidence"), F.concat("event_type", F.lit(" because")).alias("why"))
    replies = e.select(F.to_json(F.array(said)).alias("reply"))
    wanted = e.where("event_id % 2 = 0").select(i.alias("doc_id"))
    return read_labels(replies, wanted).select("doc_id", "label", F.left("why", F.lit(10)).alias("why"), "is_relevant", "confidence")


@query("prj_readiness", D("sd prices", "SELECT code, CASE WHEN p >= 2000 AND pct >= 70 THEN 'ready' WHEN p >= 2000 AND n > 0 THEN 'labelling' WHEN p >= 2000 THEN 'collecting' ELSE 'preparing' END AS state FROM (SELECT code, count(*) * (code[2:]::INT + 1) // 2 AS p FROM prices GROUP BY code) JOIN (SELECT code, sum(doc_cnt) AS n, 100.0 * sum(canonical_cnt) / sum(doc_cnt) AS pct FROM sd GROUP BY code) USING (code)"))
def prj_readiness(spark, d):
    days = prices(spark, d).groupBy("code").agg(F.count("*").alias("p")).withColumn("p", F.floor(F.col("p") * (F.substring("code", 2, 9).cast("int") + 1) / 2))
    pct = sentiment_daily(spark, d).groupBy("code").agg(F.sum("doc_cnt").alias("n"), (100.0 * F.sum("canonical_cnt") / F.sum("doc_cnt")).alias("pct"))
    return days.join(pct, "code").select("code", fin.readiness(F.col("p"), F.col("n"), F.col("pct")).alias("state"))


@query("fn_normalize_title")
def fn_normalize_title(spark, d):
    return titles(spark, d).select("doc_id", tx.normalize_title(F.col("title"), ("The",)).alias("norm"))


_PLAIN = "lower(regexp_replace(title, '[^0-9A-Za-z가-힣]', '', 'g'))"


def _plain():
    return F.lower(F.regexp_replace("title", "[^0-9A-Za-z가-힣]", ""))


@query("fn_title_hash", D("titles", f"SELECT doc_id, sha1({_PLAIN}) AS hash FROM titles"))
def fn_title_hash(spark, d):
    return titles(spark, d).select("doc_id", tx.title_hash(_plain()).alias("hash"))


@query("fn_body_hash", "SELECT doc_id, CASE WHEN length(b) > 0 THEN sha1(b) END AS hash FROM (SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g') AS b FROM documents)")
def fn_body_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.body_hash(F.col("text"), unicode=False).alias("hash"))


@query("fn_shingles", D("titles", f"SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n < 3 THEN 1 ELSE n - 2 END AS k, CASE WHEN n >= 3 THEN substr(s, n - 2, 3) ELSE s END AS last FROM (SELECT doc_id, {_PLAIN} AS s, length({_PLAIN}) AS n FROM titles)"))
def fn_shingles(spark, d):
    s = tx.shingles(_plain())
    return titles(spark, d).select("doc_id", F.size(s).cast("long").alias("k"), F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")).alias("last"))


_SIM = f"""+ g AS (SELECT doc_id, ('0x' || left(md5(CASE WHEN length(s) < 3 THEN s ELSE substr(s, i, 3) END), 16))::UBIGINT AS h
  FROM (SELECT doc_id, s, unnest(range(1, greatest(length(s) - 1, 2))) AS i FROM (SELECT doc_id, {_PLAIN} AS s FROM titles) WHERE length(s) > 0)),
v AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS votes FROM g, range(0, 64) r(b) GROUP BY 1, 2),
sim AS (SELECT t.doc_id, coalesce(u, 0::HUGEINT) AS u FROM titles t LEFT JOIN (SELECT doc_id, sum(CASE WHEN votes > 0 THEN 1::HUGEINT << b::INT ELSE 0 END) AS u FROM v GROUP BY 1) USING (doc_id)),
signed AS (SELECT doc_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS simhash, u::HUGEINT AS u FROM sim)"""


@query("fn_simhash64", D("titles", f"{_SIM} SELECT doc_id, simhash FROM signed"))
def fn_simhash64(spark, d):
    return titles(spark, d).select("doc_id", tx.simhash64(_plain()).alias("simhash"))


@query("fn_bands", D("titles", f"{_SIM} SELECT doc_id, (u & 65535)::BIGINT AS b0, ((u >> 16) & 65535)::BIGINT AS b1, ((u >> 32) & 65535)::BIGINT AS b2, ((u >> 48) & 65535)::BIGINT AS b3 FROM signed"))
def fn_bands(spark, d):
    return titles(spark, d).select("doc_id", tx.bands(tx.simhash64(_plain())).alias("b")).select("doc_id", *[F.col("b")[k].alias(f"b{k}") for k in range(4)])


@query("fn_hamming", "SELECT l_orderkey, l_linenumber, bit_count(xor(l_orderkey, l_partkey))::INT AS bits FROM lineitem")
def fn_hamming(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.hamming(F.col("l_orderkey"), F.col("l_partkey")).cast("int").alias("bits"))


@query("fn_blocking_key", D("titles", f"SELECT left({_PLAIN}, 8) AS key, count(*) AS n FROM titles GROUP BY 1"))
def fn_blocking_key(spark, d):
    return titles(spark, d).groupBy(tx.blocking_key(_plain()).alias("key")).agg(F.count("*").alias("n"))


@query("fn_token_set_ratio")
def fn_token_set_ratio(spark, d):
    t = titles(spark, d).select("doc_id", _plain().alias("s"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("next")), "doc_id").select("doc_id", tx.indel_ratio("s", "next").alias("ratio"))


@query("fn_to_utc", "SELECT event_id, ts - INTERVAL 9 HOUR AS utc, (ts + INTERVAL 9 HOUR)::DATE AS kst_date FROM events")
def fn_to_utc(spark, d):
    t = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", fin.to_utc(t).cast("timestamp_ntz").alias("utc"), fin.kst_date(t).alias("kst_date"))


_SIGNAL = "CASE WHEN strftime(published_utc + INTERVAL 9 HOUR, '%H:%M') <= '08:50' THEN kst_date ELSE (kst_date + 1)::DATE END"


@query("fn_signal_date", D("docs", f"SELECT doc_id, {_SIGNAL} AS signal_date FROM docs WHERE published_utc IS NOT NULL"))
def fn_signal_date(spark, d):
    return documents(spark, d).where("published_utc IS NOT NULL").select("doc_id", fin.signal_date(F.col("published_utc")).alias("signal_date"))


@query("fn_polarity", D("sd", "SELECT code, kst_date, media_id, signal_date, round(CASE WHEN pos + neg > 0 THEN (pos - neg) / (pos + neg)::DOUBLE * ((pos + neg) / (pos + neg + 10.0::DOUBLE)) END, 9) AS polarity FROM sd"))
def fn_polarity(spark, d):
    return sentiment_daily(spark, d).select("code", "kst_date", "media_id", "signal_date", F.round(fin.polarity(F.col("pos"), F.col("neg")), 9).alias("polarity"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query("fn_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def fn_host(spark, d):
    return table(spark, d, "pages").select("page_id", tx.host(F.col("url")).alias("host"))


@query("fn_regdom", f"SELECT page_id, CASE WHEN len(p) >= 2 THEN array_to_string(p[len(p) - CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'or', 'ne', 'go', 'ac', 'com', 'net', 'org', 'gov', 'edu') THEN 2 ELSE 1 END:], '.') END AS domain FROM (SELECT page_id, string_split(regexp_replace({_HOST}, '\\.+$', ''), '.') AS p FROM pages)")
def fn_regdom(spark, d):
    return table(spark, d, "pages").select("page_id", tx.registrable(tx.host(F.col("url"))).alias("domain"))


@query("fn_registrable_domain", D("media", "SELECT media_id, CASE WHEN len(p) <= 2 THEN domain ELSE array_to_string(p[len(p) - CASE WHEN p[-1] = 'kr' AND p[-2] IN ('co', 'or', 'ne', 'go', 'pe', 're') THEN 2 ELSE 1 END:], '.') END AS domain FROM (SELECT media_id, domain, string_split(domain, '.') AS p FROM media)"))
def fn_registrable_domain(spark, d):
    return media(spark, d).select("media_id", tx.registrable_kr(F.col("domain")).alias("domain"))


@query("fn_oid", D("docs", "SELECT doc_id, nullif(regexp_extract(url, '/article/(\\d+)/', 1), '') AS oid FROM docs"))
def fn_oid(spark, d):
    return documents(spark, d).select("doc_id", tx.article_id(F.col("url")).alias("oid"))


@query("fn_strip_outlet", D("titles", "SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN title || ' - Outlet One' ELSE title END, '\\s+-\\s+[^-]{1,40}$', '')) AS title FROM titles"))
def fn_strip_outlet(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("title", F.lit(" - Outlet One"))).otherwise(F.col("title"))
    return titles(spark, d).select("doc_id", tx.strip_outlet(t).alias("title"))


@query("fn_html_clean", f"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '&gt;&gt;\\d+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[{tx.BLANK}]+', ' ', 'g'))) AS n FROM pages")
def fn_html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(tx.clean_html(F.col("html"), unescape=False)).cast("long").alias("n"))


@query("fn_html_unescape")
def fn_html_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean_html(F.col("html")).alias("text"))


@query("fn_json_list", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fallback' END AS first FROM events")
def fn_json_list(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("event_type"))).when(F.col("event_id") % 3 == 0, F.lit("[]")).otherwise(F.lit("not json"))
    return table(spark, d, "events").select("event_id", F.coalesce(tx.json_list(raw)[0], F.lit("fallback")).alias("first"))


@query("fn_fee_charge", "SELECT l_orderkey, l_linenumber, round(abs(q) * l_extendedprice * (5.0::DOUBLE + CASE WHEN q > 0 THEN 1.5::DOUBLE WHEN q < 0 THEN 19.5::DOUBLE ELSE 0 END) / 10000, 8) AS cost FROM (SELECT *, l_quantity - 25 AS q FROM lineitem)")
def fn_fee_charge(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fin.fee_charge(F.col("l_quantity") - 25, F.col("l_extendedprice"), FEES), 8).alias("cost"))


@query("fn_carry", "SELECT l_orderkey, l_linenumber, round(((CASE WHEN q < 0 THEN -q * l_extendedprice * 280.0::DOUBLE ELSE 0 END) + (CASE WHEN c < 0 THEN -c * 938.0::DOUBLE ELSE 0 END)) / 10000 / 365, 6) AS carry FROM (SELECT *, l_quantity - 25 AS q, 30000 - l_extendedprice AS c FROM lineitem)")
def fn_carry(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fin.carry_charge(F.col("l_quantity") - 25, x, 30000 - x, FEES), 6).alias("carry"))


@query("fn_corr_guard", "SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 10 AND stddev_pop(l_quantity) > 1e-12 AND stddev_pop(l_discount) > 1e-12 THEN corr(l_quantity, l_discount) END, 8) AS r FROM lineitem GROUP BY l_suppkey")
def fn_corr_guard(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(fin.safe_corr(F.col("l_quantity"), F.col("l_discount")), 8).alias("r"))


@query("fn_coalesce_open", D("prices", "SELECT code, kst_date, coalesce(nullif(open, 0), close, 0) AS open FROM prices"))
def fn_coalesce_open(spark, d):
    return prices(spark, d).select("code", "kst_date", fin.tradable_open(F.col("open"), F.col("close")).alias("open"))


@query("fn_round", "SELECT event_id, CASE WHEN abs(value * 2 - round(value * 2)) < 1e-12 AND (round(value * 2)::BIGINT % 2) <> 0 THEN 2 * round(value / 2) ELSE round(value) END AS v FROM events")
def fn_round(spark, d):
    return table(spark, d, "events").select("event_id", F.bround("value", 0).alias("v"))


@query("fn_truncate", "SELECT doc_id, left(text, 300) AS title, length(left(text, 600)) AS body FROM documents")
def fn_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(300)).alias("title"), F.length(F.left("text", F.lit(600))).cast("long").alias("body"))


@query("fn_prompt", D("media", "SELECT media_id, 'Label the market sentiment of each post as positive, negative or neutral.' || CASE WHEN channel IN ('community', 'cafe') THEN ' Posts are informal; sarcasm counts as negative.' ELSE ' Posts are headlines.' END AS prompt FROM media"))
def fn_prompt(spark, d):
    from tidemark.operators.labels import prompt

    return media(spark, d).select("media_id", prompt(F.col("channel")).alias("prompt"))
