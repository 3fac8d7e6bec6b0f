"""Column functions on titles, names and addresses.

Everything is built in, but for Unicode normalisation, HTML entities and the longest common subsequence, which Spark
does not have and which are Arrow-batched.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLACEMENT = "�"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def normalize_title(title: Column, aliases: tuple[str, ...] = (), unicode: bool = True) -> Column:
    """A title's comparable core: composed, without tags in brackets, aliases, trailing number, long repeats and marks."""
    t = nfkc(title) if unicode else title
    t = F.regexp_replace(t, r"[\[\(<【〔][^\]\)>】〕]{0,20}[\]\)>】〕]", " ")
    for alias in filter(None, aliases):
        t = F.replace(t, F.lit(alias), F.lit(" "))
    t = F.regexp_replace(t, r"[\s\-_.]*\d+\s*$", "")
    t = F.regexp_replace(t, r"(.)\1{2,}", "$1$1")
    return F.lower(F.regexp_replace(t, "[^0-9A-Za-z가-힣]", ""))


def title_hash(norm: Column) -> Column:
    return F.sha1(norm.cast("binary"))


def body_hash(body: Column, unicode: bool = True) -> Column:
    core = F.regexp_replace(nfkc(body) if unicode else body, "[^0-9A-Za-z가-힣]", "")
    return F.when(F.length(core) > 0, F.sha1(core.cast("binary")))


def shingles(s: Column, k: int = 3) -> Column:
    """Character k-grams; the string itself if it is shorter; none if it is empty."""

    def cut(chars: Column) -> Column:
        # a lambda's outer expressions run again for each element, so the split is bound once
        return F.transform(F.sequence(F.lit(0), F.size(chars) - k), lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))

    grams = F.transform(F.array(F.split(s, "")), cut)[0]
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < k, F.array(s)).otherwise(grams)


def hash64(s: Column) -> Column:
    """The first eight bytes of MD5 as a signed number."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 16), 16, -10).cast("long")


def simhash64(norm: Column) -> Column:
    """64 majority votes over the shingles' hash bits; 0 for the empty string."""
    lane, low = F.lit(0x0000000100000001).cast("long"), F.lit(0xFFFFFFFF).cast("long")

    def voted(hashes: Column) -> Column:
        # 32 sums of two 32-bit lanes hold the counts of all 64 bits in one pass over the shingles
        sums = F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), 32), lambda acc, h: F.transform(acc, lambda a, i: a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(lane)))
        bit = lambda count, at: F.when(2 * count > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
        parts = F.transform(sums, lambda s, i: bit(s.bitwiseAND(low), i).bitwiseOR(bit(F.call_function("shiftrightunsigned", s, F.lit(32)), i + 32)))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))

    return F.transform(F.array(norm), lambda s: F.when(F.length(s) == 0, F.lit(0).cast("long")).otherwise(F.transform(F.array(F.transform(shingles(s), hash64)), voted)[0]))[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocking_key(norm: Column, n: int = 8) -> Column:
    return F.substring(norm, 1, n)


def bands(simhash: Column) -> Column:
    """Four 16-bit parts."""
    return F.transform(F.array(*[F.lit(16 * k) for k in range(4)]), lambda s: F.call_function("shiftrightunsigned", simhash, s).bitwiseAND(F.lit(65535).cast("long")))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (len a + len b), the token-set score of strings without spaces; 0 if either is empty."""

    def lcs(x: str, y: str) -> int:
        # Bit-parallel: zeros of the running word mark matched columns.
        where: dict[str, int] = {}
        for k, ch in enumerate(x):
            where[ch] = where.get(ch, 0) | 1 << k
        row, full = (1 << len(x)) - 1, (1 << len(x)) - 1
        for ch in y:
            hit = row & where.get(ch, 0)
            row = (row + hit | row - hit) & full
        return len(x) - row.bit_count()

    return pd.Series([200.0 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def has_hangul(s: Column) -> Column:
    return s.rlike("[가-힣]")


def bad_chars(s: Column) -> Column:
    """Number of U+FFFD."""
    return F.length(s) - F.length(F.replace(s, F.lit(REPLACEMENT), F.lit("")))


def assert_decoded(s: Column, worst: float = 0.002) -> Column:
    """The text itself; fails the query if too much of it could not be decoded."""
    return F.when(bad_chars(s) > F.length(s) * worst, F.raise_error(F.lit("text was decoded with a wrong charset")).cast("string")).otherwise(s)


def keeps_topic(title: Column, aliases: Column, excludes: Column) -> Column:
    """With the excluded words struck out, whether any alias is still in the title; no excludes keep everything."""
    left = F.aggregate(excludes, title, lambda t, x: F.replace(t, x, F.lit(" ")))
    return F.when(F.size(excludes) == 0, True).otherwise(F.exists(aliases, lambda a: F.contains(left, a)))


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)) if terms else F.lit(False)


def host(url: Column) -> Column:
    """The address's host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


#: Second-level labels under which names are registered (fixed values).
SECOND_LEVEL = ("co", "or", "ne", "go", "ac", "com", "net", "org", "gov", "edu")


def registrable(name: Column) -> Column:
    """The registrable domain of a name that looks like one, else null: three labels below a second-level name, else two."""
    clean = F.regexp_replace(F.lower(F.trim(name)), r"\.+$", "")
    parts = F.split(clean, r"\.")
    n = F.size(parts)
    long = (n >= 3) & F.element_at(parts, -2).isin(*SECOND_LEVEL)
    tail = F.array_join(F.slice(parts, F.greatest(n - F.when(long, 2).otherwise(1), F.lit(1)), F.when(long, 3).otherwise(2)), ".")
    return F.when((n >= 2) & ~F.contains(clean, F.lit(" ")) & ~F.contains(clean, F.lit("/")), tail)


#: Names under .kr below which names are registered (fixed values).
KR_SECOND_LEVEL = ("co", "or", "ne", "go", "pe", "re")


def registrable_kr(name: Column) -> Column:
    """The variant that knows second levels under .kr only."""
    clean = F.regexp_replace(name, r"^www\.", "")
    parts = F.split(clean, r"\.")
    n = F.size(parts)
    long = (n >= 3) & (F.element_at(parts, -1) == "kr") & F.element_at(parts, -2).isin(*KR_SECOND_LEVEL)
    return F.when(n <= 2, clean).otherwise(F.array_join(F.slice(parts, n - F.when(long, 2).otherwise(1), F.when(long, 3).otherwise(2)), "."))


def article_id(url: Column) -> Column:
    """The outlet number in /article/<digits>/, else null."""
    return F.nullif(F.regexp_extract(url, r"/article/(\d+)/", 1), F.lit(""))


def strip_outlet(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s+-\s+[^-]{1,40}$", ""))


#: White space of any script, as a class of a pattern.
BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _squeezed(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, f"[{BLANK}]+", " "), "^ | $", "")


def clean_html(raw: Column, unescape: bool = True) -> Column:
    """Plain text of a post: references to other posts and tags become spaces, white space is squeezed."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"&gt;&gt;\d+", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return _squeezed(html_unescape(t) if unescape else t)


def element_text(raw: Column, unescape: bool = True) -> Column:
    """The text nodes of an element, each without white space around it, one after the other."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), f"[{BLANK}]*<[^>]+>[{BLANK}]*", "")
    t = html_unescape(t) if unescape else t
    return F.regexp_replace(t, f"^[{BLANK}]+|[{BLANK}]+$", "")


def unmarked(raw: Column) -> Column:
    """A search result's text without the marks of its hits."""
    return F.regexp_replace(html_unescape(F.regexp_replace(F.coalesce(raw, F.lit("")), "</?b>", "")), f"^[{BLANK}]+|[{BLANK}]+$", "")


def json_list(column: Column) -> Column:
    """A JSON array of strings; empty or unreadable ones are null, for ``coalesce`` chains."""
    got = F.filter(F.from_json(column, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(got) > 0, got)
