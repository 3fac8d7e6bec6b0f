"""Queries on sources: raw documents are made of the test tables, then read as a collector would."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.plans.proxies import documents, prices, table, with_
from tidemark.plans.registry import query
from tidemark.sources import parsers
from tidemark.streaming import ingest

D = with_


@query("src_rss", "SELECT event_id, event_type || ' ' || event_id AS title, 'http://www.m' || (user_id % 12) || '.example.com/a' AS url, 'm' || (user_id % 12) || '.example.com' AS host, date_trunc('second', ts) AS published_utc FROM events")
def src_rss(spark, d):
    e = table(spark, d, "events").withColumn("stamp", F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"))
    xml = F.concat(F.lit("<rss><channel><item><title>"), "event_type", F.lit(" "), "event_id", F.lit(" - Some Outlet</title><link>http://www.m"), F.col("user_id") % 12, F.lit(".example.com/a</link><pubDate>"), "stamp", F.lit(" GMT</pubDate><source>Some Outlet</source></item></channel></rss>"))
    return parsers.parse_rss(e.select("event_id", xml.alias("xml"))).select("event_id", "title", "url", "host", F.col("published_utc").cast("timestamp_ntz").alias("published_utc"))


@query("src_rss_adaptive")
def src_rss_adaptive(spark, d):
    days = {r["d"]: r["n"] for r in table(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a day

    def size(w):
        return sum(days.get(w[0] + datetime.timedelta(days=k), 0) for k in range((w[1] - w[0]).days))

    lo = min(days)
    got = parsers.plan_windows(lo, max(days) + datetime.timedelta(days=1), size, full=max(2, 4 * sum(days.values()) // len(days)))
    return spark.createDataFrame(got, "start date, end date")


@query("src_rss_combo", "SELECT n_name AS code, 'ko' AS locale, n_name || ' 주가' AS query FROM nation UNION ALL SELECT n_name, 'en', n_name FROM nation")
def src_rss_combo(spark, d):
    e = table(spark, d, "nation").select(F.col("n_name").alias("code"), F.col("n_name").alias("name"), F.array(F.array(F.lit("ko"), F.lit("KR")), F.array(F.lit("en"), F.lit("US"))).alias("locales"), F.array("n_name").alias("aliases"), F.array("n_name", F.concat("n_name", F.lit(" 주가"))).alias("queries"))
    return parsers.locale_queries(e).select("code", F.col("locale")[0].alias("locale"), "query")


@query("src_naver_board", "SELECT event_id AS nid, date_trunc('minute', ts) AS posted, event_type AS title, user_id::VARCHAR AS author, floor(value)::BIGINT AS views FROM events")
def src_naver_board(spark, d):
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    e = table(spark, d, "events")
    row = F.concat(F.lit("<tr>"), cell(F.date_format(F.col("ts").cast("timestamp"), "yyyy.MM.dd HH:mm")), F.concat(F.lit('<td class="title"><a href="/read?nid='), "event_id", F.lit('&page=1"'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(' title="'), "event_type", F.lit('"'))).otherwise(""), F.lit(">"), F.when(F.col("event_id") % 2 == 0, "short").otherwise(F.col("event_type")), F.lit("</a></td>")), cell(F.col("user_id").cast("string")), cell(F.format_number(F.floor("value"), 0)), cell(F.lit("1")), cell(F.lit("2")), F.lit("</tr><tr><td>notice</td></tr>"))
    return parsers.parse_board(e.select(row.alias("html"))).select("nid", F.col("posted").cast("timestamp_ntz").alias("posted"), "title", "author", "views")


@query("src_naver_news", "SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)) AS u FROM pages) GROUP BY 1")
def src_naver_news(spark, d):
    return parsers.parse_links(table(spark, d, "pages").select("page_id", "html")).groupBy("page_id").agg(F.count("*").alias("links"))


@query("src_naver_article")
def src_naver_article(spark, d):
    return table(spark, d, "pages").select("page_id", parsers.parse_article(F.col("html")).alias("body"))


@query("src_naver_api", "SELECT event_id, event_type || ' & more' AS title, 'm' || (user_id % 12) || '.co.kr' AS domain FROM events")
def src_naver_api(spark, d):
    item = F.struct(F.concat(F.lit("<b>"), "event_type", F.lit("</b> &amp; more")).alias("title"), F.concat(F.lit("http://www.m"), F.col("user_id") % 12, F.lit(".co.kr/x")).alias("link"))
    raw = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.lit(1).alias("total"), F.array(item).alias("items"))).alias("json"))
    return parsers.parse_search(raw).select("event_id", "title", "domain")


@query("src_4chan", "SELECT event_id AS no, event_id % 500 AS replies FROM events WHERE event_type IN ('purchase', 'signup') ORDER BY event_id % 500 DESC, event_id LIMIT 60")
def src_4chan(spark, d):
    thread = F.struct(F.col("event_id").alias("no"), F.lit("subject of").alias("sub"), F.concat("event_type", F.lit("<br>&gt;x")).alias("com"), (F.col("event_id") % 500).alias("replies"), F.lit(1700000000).alias("time"))
    raw = table(spark, d, "events").select(F.to_json(F.array(F.struct(F.lit(1).alias("page"), F.array(thread).alias("threads")))).alias("json"))
    return parsers.parse_catalog(raw, ("Purchase", "signup")).select("no", "replies")


@query("src_http", "SELECT doc_id, text FROM documents")
def src_http(spark, d):
    """Pages whose charset is in the header, in the page, or nowhere."""
    k = F.col("doc_id") % 3
    header = F.when(k == 0, "text/html; charset=utf-8").otherwise("text/html")
    got = parsers.decode_body(F.encode(F.concat(F.when(k == 1, '<meta charset="utf-8">').otherwise(""), "text"), "UTF-8"), header)
    return table(spark, d, "documents").select("doc_id", F.substr(got, F.when(k == 1, 23).otherwise(1)).alias("text"))


#: "stock market" in the site's charset.
EUC_KR = "주식 시장".encode("euc-kr")


@query("src_http_euckr", "SELECT event_id, '주식 시장 ' || event_type AS text FROM events")
def src_http_euckr(spark, d):
    body = F.concat(F.lit(bytearray(EUC_KR)), F.encode(F.concat(F.lit(" "), "event_type"), "US-ASCII"))
    k = F.col("event_id") % 2
    page = F.concat(F.when(k == 0, F.encode(F.lit("<meta charset=euc-kr>"), "US-ASCII")).otherwise(F.lit(bytearray())), body)
    got = parsers.decode_body(page, F.when(k == 0, "text/html").otherwise("text/html; charset=EUC-KR"))
    return table(spark, d, "events").select("event_id", F.replace(got, F.lit("<meta charset=euc-kr>"), F.lit("")).alias("text"))


def _written(spark, name: str, lines):
    from tidemark.plans.tables import _scratch

    path = _scratch(spark, name)
    lines.coalesce(1).write.text(path)
    return path


@query("src_csv_entities", "SELECT 'N' || n_nationkey AS code, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE n_nationkey % 3 END::INT AS priority, CASE WHEN n_nationkey % 4 = 1 THEN 'en-US' WHEN n_nationkey % 4 = 2 THEN 'ko,en-US' ELSE 'ko' END AS languages, 2 AS aliases, (n_nationkey % 2)::INT AS queries FROM nation")
def src_csv_entities(spark, d):
    k = F.col("n_nationkey")
    fields = [F.concat(F.lit("N"), k), F.lit("index"), F.col("n_name"), F.lit("KRX"), F.when(k % 3 == 0, "").otherwise((k % 3).cast("string")), F.element_at(F.array(F.lit("ko"), F.lit("en"), F.lit("ko+en"), F.lit("")), (k % 4 + 1).cast("int")), F.concat(F.lit("a| "), "n_name"), F.lit(""), F.when(k % 2 == 1, "q").otherwise("")]
    rows = table(spark, d, "nation").select(F.concat_ws(",", *fields).alias("value"))
    head = spark.createDataFrame([("code,kind,name,calendar,priority,locales,aliases,exclude,queries",), ("# a remark",)], "value string")
    x = parsers.read_entities(spark, _written(spark, "entities", head.union(rows)))
    return x.select("code", "name", "priority", F.array_join(F.transform("locales", lambda v: v[0]), ",").alias("languages"), F.size("aliases").alias("aliases"), F.size("queries").alias("queries"))


@query("src_csv_rules", "SELECT n_name AS canonical, 'daily' AS tier, n_name || '|x' || n_nationkey AS aliases, CASE WHEN n_nationkey % 2 = 0 THEN 'cafe' ELSE 'news' END AS channel FROM nation")
def src_csv_rules(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("daily, "), "n_name", F.lit(",x"), k, F.when(k % 2 == 0, ", cafe").otherwise("")).alias("value"))
    head = spark.createDataFrame([("# a remark",), ("tier,canonical,aliases,channel",)], "value string")
    x = parsers.read_rules(spark, _written(spark, "rules", head.union(rows)))
    return x.select("canonical", "tier", F.array_join("aliases", "|").alias("aliases"), "channel")


_BARS = "SELECT o_orderdate::DATE AS kst_date, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE o_totalprice - 1 END AS open, o_totalprice AS close FROM orders WHERE o_orderkey % 7 <> 0 {w}"


def _bars(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.when(k % 10 == 0, None).when(k % 5 == 0, 0.0).otherwise(F.col("o_totalprice") - 1).alias("open"), F.lit(None).cast("double").alias("high"), F.lit(0.0).alias("low"), F.when(k % 14 == 0, None).when(k % 7 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("close"), F.lit(1).alias("volume"))


query("src_price_mkt", _BARS.format(w=""))(lambda spark, d: parsers.clean_bars(_bars(spark, d), "X", "a").select("kst_date", "open", "close"))
query("src_price_krx", _BARS.format(w="AND o_orderdate >= DATE '1998-01-01'"))(lambda spark, d: parsers.clean_bars(_bars(spark, d), "X", "a", "1998-01-01").select("kst_date", "open", "close"))


@query("src_master", "SELECT 'S' || s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE s_name END AS name FROM supplier")
def src_master(spark, d):
    from tidemark.operators.ledger import upsert

    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), F.col("s_name").alias("name"), "s_suppkey")
    new = s.where("s_suppkey % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    return upsert(s.drop("s_suppkey"), new.drop("s_suppkey"), ["code"])


@query("src_legacy", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 9 HOUR END AS published_utc FROM events WHERE event_type IN ('view', 'click')")
def src_legacy(spark, d):
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    old = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, F.concat(t, F.lit("+00:00"))).otherwise(t).alias("published"))
    return parsers.legacy_rows(old, ("view", "click")).select("event_id", F.col("published_utc").cast("timestamp_ntz").alias("published_utc"))


@query("stream_signal_date", D("docs", "SELECT doc_id, CASE WHEN strftime(published_utc + INTERVAL 9 HOUR, '%H:%M') <= '08:50' THEN kst_date ELSE (kst_date + 1)::DATE END AS signal_date FROM docs WHERE published_utc IS NOT NULL"))
def stream_signal_date(spark, d):
    return ingest.with_signal_date(documents(spark, d)).select("doc_id", "signal_date")


@query("stream_live_counts")
def stream_live_counts(spark, d):
    return ingest.live_counts(documents(spark, d).where("published_utc IS NOT NULL"))
