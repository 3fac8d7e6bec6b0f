"""Responses of feeds, pages and search interfaces as rows; fetching is left to whoever has a network."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import any_term, clean_html, element_text, has_hangul, host, registrable_kr, strip_outlet, unmarked

# ---- feeds -------------------------------------------------------------------------------------------------------
ITEM = "array<struct<title:string,link:string,pubDate:string,source:string>>"


def parse_rss(raw: DataFrame, column: str = "xml") -> DataFrame:
    """Items of RSS documents: title without its outlet, address, host, outlet and time in UTC."""
    item = lambda tag: F.call_function("xpath", F.col(column), F.lit(f"//item/{tag}/text()"))
    zipped = F.arrays_zip(item("title").alias("title"), item("link").alias("link"), item("pubDate").alias("pubDate"), item("source").alias("source"))
    others = [c for c in raw.columns if c != column]
    x = raw.select(*others, F.explode(zipped).alias("i"))
    stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return x.select(*others, strip_outlet(F.col("i.title")).alias("title"), F.col("i.link").alias("url"), host(F.col("i.link")).alias("host"), F.col("i.source").alias("outlet"), stamp.alias("published_utc"))


Window = tuple[datetime.date, datetime.date]


def plan_windows(start: datetime.date, end: datetime.date, size: Callable[[Window], int], step: int = 32, full: int = 100, depth: int = 8) -> list[Window]:
    """Half-open date windows to fetch: a window whose answer is full is halved, down to a day or ``depth`` halvings."""

    def split(a: datetime.date, b: datetime.date, level: int) -> list[Window]:
        days = (b - a).days
        if days <= 1 or level >= depth or size((a, b)) < full:
            return [(a, b)]
        mid = a + datetime.timedelta(days=days // 2)
        return split(a, mid, level + 1) + split(mid, b, level + 1)

    out, at = [], start
    while at < end:
        after = min(at + datetime.timedelta(days=step), end)
        out += split(at, after, 0)
        at = after
    return out


def locale_queries(entities: DataFrame) -> DataFrame:
    """(code, locale, query): every locale of an entity with its queries in that script; the name where it has none."""
    named = F.when(F.size("queries") > 0, F.col("queries")).when(F.size("aliases") > 0, F.col("aliases")).otherwise(F.array("name"))
    x = entities.select("code", F.explode("locales").alias("locale"), named.alias("names")).select("code", "locale", F.explode("names").alias("query"))
    return x.where(has_hangul(F.col("query")) == (F.col("locale")[0] == "ko"))


# ---- pages -------------------------------------------------------------------------------------------------------
def rows_of(html: Column) -> Column:
    """The cells' text of every table row."""
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: element_text(c, unescape=False))
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def parse_board(pages: DataFrame, column: str = "html") -> DataFrame:
    """Posts of a message board's list: time, title, author, views, votes and id; rows that are no posts go.

    A link's own title is the post's, where it has one.  Cells that are missing or no numbers are null.
    """
    others = [c for c in pages.columns if c != column]
    raw = F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    x = pages.select(*others, F.explode(F.arrays_zip(raw.alias("raw"), rows_of(F.col(column)).alias("cells"))).alias("r"))
    link = r"(?is)<a\b([^>]*nid=[^>]*)>(.*?)</a>"
    x = x.withColumns({"tag": F.regexp_extract("r.raw", link, 1), "said": element_text(F.regexp_extract("r.raw", link, 2), unescape=False)})
    cell = lambda k: F.get(F.col("r.cells"), k)
    number = lambda k: F.expr(f"try_cast(replace(get(r.cells, {k}), ',', '') as bigint)")
    titled = F.nullif(F.trim(F.regexp_extract("tag", r"(?i)\btitle=[\"']([^\"']*)[\"']", 1)), F.lit(""))
    out = x.where(F.size("r.cells") >= 3).select(
        *others,
        F.nullif(F.regexp_extract("tag", r"nid=(\d+)", 1), F.lit("")).cast("long").alias("nid"),
        F.try_to_timestamp(cell(0), F.lit("yyyy.MM.dd HH:mm")).alias("posted"),
        F.coalesce(titled, "said").alias("title"),
        F.nullif(cell(2), F.lit("")).alias("author"),
        number(3).alias("views"),
        number(4).alias("up"),
        number(5).alias("down"),
    )
    return out.where("nid IS NOT NULL AND posted IS NOT NULL")


def parse_links(pages: DataFrame, column: str = "html") -> DataFrame:
    """(… , url, text) of every link of a page."""
    others = [c for c in pages.columns if c != column]
    hit = F.lit(r"(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>")
    zipped = F.arrays_zip(F.regexp_extract_all(column, hit, F.lit(1)).alias("url"), F.regexp_extract_all(column, hit, F.lit(2)).alias("text"))
    return pages.select(*others, F.explode(zipped).alias("a")).select(*others, F.col("a.url").alias("url"), element_text(F.col("a.text"), unescape=False).alias("text"))


def parse_article(html: Column) -> Column:
    """An article's text without scripts and styles."""
    return clean_html(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), unescape=False)


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, header: pd.Series) -> pd.Series:
    """Bytes as text: the header's charset, else the page's own, else UTF-8 or, where it is not that, Korean.

    Any charset that Python knows; unknown names count as UTF-8.  Bytes that cannot be read become U+FFFD.
    """
    import codecs
    import re

    named = re.compile(r"charset=[\"']?([\w\-]+)", re.I)

    def read(raw: bytes | None, head: str | None) -> str | None:
        if raw is None:
            return None
        found = named.search(head or "") or named.search(raw[:4096].decode("latin-1"))
        if not found:
            for guess in ("utf-8", "cp949"):
                try:
                    return raw.decode(guess)
                except UnicodeDecodeError:
                    continue
            return raw.decode("utf-8", "replace")
        try:
            codecs.lookup(found[1])
        except LookupError:
            return raw.decode("utf-8", "replace")
        return raw.decode(found[1], "replace")

    return pd.Series([read(b, h) for b, h in zip(body, header, strict=True)], dtype=object)


# ---- JSON --------------------------------------------------------------------------------------------------------
SEARCH = "struct<total:bigint,items:array<struct<title:string,link:string,originallink:string,description:string,pubDate:string>>>"


def parse_search(raw: DataFrame, column: str = "json") -> DataFrame:
    """Items of a search interface's answers, tags stripped, with the outlet's registrable domain."""
    others = [c for c in raw.columns if c != column]
    x = raw.select(*others, F.explode(F.from_json(column, SEARCH)["items"]).alias("i"))
    url = F.coalesce(F.nullif(F.col("i.originallink"), F.lit("")), F.col("i.link"))
    return x.select(*others, unmarked(F.col("i.title")).alias("title"), url.alias("url"), registrable_kr(host(url)).alias("domain"), unmarked(F.col("i.description")).alias("body"), F.lit("approx").alias("ts_confidence"))


CATALOG = "array<struct<page:int,threads:array<struct<no:bigint,sub:string,com:string,replies:bigint,time:bigint>>>>"


def parse_catalog(raw: DataFrame, terms: tuple[str, ...], column: str = "json", most: int = 60, least_chars: int = 12) -> DataFrame:
    """Threads of a board's catalog that mention a term, most replies first."""
    x = raw.select(F.explode(F.from_json(column, CATALOG)).alias("p")).select(F.explode("p.threads").alias("t"))
    text = F.concat_ws(" ", clean_html(F.col("t.sub")), clean_html(F.col("t.com")))
    x = x.select(F.col("t.no").alias("no"), F.left(text, F.lit(300)).alias("title"), text.alias("text"), F.col("t.replies").alias("replies"), F.timestamp_seconds("t.time").alias("published_utc"))
    return x.where((F.length("text") >= least_chars) & any_term(F.col("text"), terms)).orderBy(F.col("replies").desc(), "no").limit(most)


# ---- files -------------------------------------------------------------------------------------------------------
def _items(c: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


#: Language, country and edition of the feeds that a locale key stands for; other keys stand for "ko" (fixed values).
LOCALES = {"ko": (("ko", "KR", "KR:ko"),), "en": (("en-US", "US", "US:en"),), "ko+en": (("ko", "KR", "KR:ko"), ("en-US", "US", "US:en"))}


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities from a headed CSV with # comments; the last four columns are pipe-separated lists and may be missing."""
    names = ["code", "kind", "name", "calendar", "priority", "locales", "aliases", "exclude", "queries"]
    x = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=True, comment="#", enforceSchema=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    locales = F.lit(None)
    for key, value in LOCALES.items():
        locales = F.when(F.col("locales") == key, F.array(*[F.array(*map(F.lit, v)) for v in value])).otherwise(locales)
    plain = F.array(*[F.array(*map(F.lit, v)) for v in LOCALES["ko"]])
    lists = {"locales": F.coalesce(locales, plain), **{c: _items(c) for c in ("aliases", "exclude", "queries")}}
    return x.where("code IS NOT NULL").select("code", "kind", "name", "calendar", F.coalesce(F.expr("try_cast(priority as int)"), F.lit(2)).alias("priority"), *[v.alias(k) for k, v in lists.items()], F.lit(1).alias("is_active"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Outlet rules in the file's order: tier, canonical name, aliases and an optional channel, news if blank."""
    lines = spark.read.text(path).coalesce(1).withColumn("at", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*(#|$)") & ~F.col("value").startswith("tier,"))
    x = lines.select("at", F.from_csv("value", F.lit("tier string, canonical string, aliases string, channel string")).alias("r")).select("at", "r.*")
    trimmed = F.coalesce(F.nullif(F.trim("channel"), F.lit("")), F.lit("news"))
    return x.select(F.col("at").cast("int").alias("rule"), F.trim("tier").alias("tier"), F.trim("canonical").alias("canonical"), F.array_distinct(F.concat(F.array(F.trim("canonical")), _items("aliases"))).alias("aliases"), trimmed.alias("channel"))


def clean_bars(raw: DataFrame, code: str, source: str, since: str | None = None) -> DataFrame:
    """Bars of one symbol: no close, no bar; a missing or zero open, high or low is the close."""
    close = F.col("close").cast("double")
    x = raw.where(close.isNotNull() & ~F.isnan(close))
    if since:
        x = x.where(F.col("date") >= F.lit(since).cast("date"))
    other = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), close).alias(c)
    return x.select(F.lit(code).alias("code"), F.col("date").cast("date").alias("kst_date"), other("open"), other("high"), other("low"), close.alias("close"), F.coalesce(F.col("volume").cast("long"), F.lit(0)).alias("volume"), F.lit(source).alias("source"))


def legacy_rows(old: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Rows of an older store from known sources; naive times are Korean."""
    naive = ~F.col("published").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    stamp = F.when(naive, F.to_utc_timestamp(F.try_to_timestamp("published"), "Asia/Seoul")).otherwise(F.try_to_timestamp("published"))
    return old.where(F.col("source").isin(*sources)).withColumn("published_utc", stamp).drop("published")
