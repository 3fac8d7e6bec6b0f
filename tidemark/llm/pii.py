"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are reported whenever pattern and validator agree.  Further kinds (iban by mod 97,
secret, key, id) are added only if their score, raised by context words in the characters before, reaches a threshold:
secrets that name themselves and account numbers with a right checksum do so alone, bare hexadecimal keys and identity
numbers only with a word nearby that says what they are.

Everything is DataFrame functions.  Positions come from cutting the text at the pattern: match k starts after the first
k + 1 pieces and k matches.  The patterns have no nested backtracking (possessive groups, looks behind), so long runs of
one character stay linear; the spans are those of the plain patterns.

Null text is empty and has no spans; repeated rows are treated alike; offsets are code points, ends exclusive; an empty
table gives an empty result; other columns are ignored or, in ``redact``, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match of EMAIL starts where a run of local characters does, or where the match before ended.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number by country (fixed values).
IBAN_LENGTHS = {
    15: ("NO",),
    16: ("BE",),
    18: ("DK", "FI", "FO", "GL", "NL"),
    19: ("MK", "SI"),
    20: ("AT", "BA", "EE", "KZ", "LT", "LU", "XK"),
    21: ("CH", "HR", "LI", "LV"),
    22: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"),
    23: ("AE", "GI", "IL", "IQ", "OM", "TL"),
    24: ("AD", "CZ", "DZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("AO", "CV", "GW", "LY", "MZ", "PT", "ST"),
    26: ("IS", "TR"),
    27: ("BI", "BF", "BJ", "CF", "CG", "CM", "DJ", "EG", "FR", "GA", "GR", "IT", "KM", "MC", "MG", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CI", "CY", "DO", "GT", "HN", "HU", "LB", "LC", "ML", "NE", "NI", "PL", "SN", "SV", "TD", "TG"),
    29: ("BR", "PS", "QA", "UA", "YE"),
    30: ("JO", "KW", "MU"),
    31: ("MT", "SC"),
    32: ("RU",),
}
#: The country tells how long the number is, so that words behind it are no part of it.
IBAN = "(?<![A-Z0-9])(?:" + "|".join(f"(?:{'|'.join(v)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{k - 4}}}" for k, v in IBAN_LENGTHS.items()) + ")(?![A-Z0-9])"
SECRET = r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])|(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_?key)\x20?[=:]\x20?[\"']?[^\s,;\"']{6,}+"
KEY = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])"
ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
THRESHOLD = 0.6
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str
    score: float
    context: str
    base: bool


#: In the order of the report.  ``hint`` is a plain test that must hold before the pattern is tried.
KINDS = (
    Kind("email", EMAIL, "@", 0.9, "(?i)mail|contact|write", True),
    Kind("ip", IP, ".", 0.7, "(?i)ip|host|server|address", True),
    Kind("card", CARD, "", 0.9, "(?i)card|visa|credit|payment", True),
    Kind("phone", PHONE, "+", 0.8, "(?i)phone|tel|call|fax|mobile", True),
    Kind("iban", IBAN, "", 0.7, "(?i)iban|account|bank|konto", False),
    Kind("secret", SECRET, "", 0.6, "(?i)key|secret|password|token", False),
    Kind("key", KEY, "", 0.4, "(?i)key|secret|password|token|credential", False),
    Kind("id", ID, "", 0.4, "(?i)ssn|social security|identity|passport|licen[cs]e no", False),
)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(F.split(digits, ""))
    total = F.aggregate(
        F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))),
        F.lit(0),
        lambda s, d: s + d,
    )
    return total % 10 == 0


def _mod97(iban: Column) -> Column:
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: (s * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: Kind, m: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.name == "card":
        n = F.length(_digits(m))
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind.name == "iban":
        return _mod97(m)
    if kind.name == "key":
        return m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    return F.lit(True)


def _hinted(kind: Kind, text: Column) -> Column:
    if kind.hint:
        return F.contains(text, F.lit(kind.hint))
    return text.rlike({"card": "[0-9]{4}|[0-9][\\x20-][0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "AKIA|password|passwd|secret|token|api_?key", "key": "[0-9a-f]{32}|[0-9A-F]{32}", "id": "[0-9]-[0-9]{2}-[0-9]"}[kind.name])


def _starts(pieces: Column, matches: Column) -> Column:
    """Start of each match: sums of lengths, taken in blocks so that many matches stay near linear."""
    both = F.transform(matches, lambda m, i: (F.length(F.element_at(pieces, i + 1)) + F.length(m)).cast("long"))
    return F.transform(F.array(both), lambda lens: _prefix(lens))[0]


def _prefix(lens: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lens) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.aggregate(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda s, x: s + x))
    sums = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))
    return F.transform(F.array(sums), lambda s: F.transform(lens, lambda _, i: F.element_at(s, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(F.slice(lens, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0).cast("long"), lambda a, x: a + x)))[0]


def _found(kind: Kind, text: str) -> dict[str, Column]:
    some = _hinted(kind, F.col(text))
    return {f"_m_{kind.name}": F.when(some, F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0)))}


def _spans(kind: Kind, text: str) -> Column:
    """Confirmed spans (kind, start, end, score), in order."""
    matches = F.col(f"_m_{kind.name}")
    pieces = F.split(F.col(text), kind.pattern, -1)

    def build(pieces: Column) -> Column:
        # a lambda's outer expressions run again for each element, so the starts are bound once
        return F.transform(F.array(_starts(pieces, matches)), lambda starts: placed(pieces, starts))[0]

    def placed(pieces: Column, starts: Column) -> Column:
        near = lambda i: F.right(F.element_at(pieces, i + 1), F.lit(CONTEXT_CHARS)).rlike(kind.context)
        every = F.transform(
            matches,
            lambda m, i: F.struct(
                F.lit(kind.name).alias("kind"),
                (F.element_at(starts, i + 1) + F.length(F.element_at(pieces, i + 1))).alias("start"),
                (F.element_at(starts, i + 1) + F.length(F.element_at(pieces, i + 1)) + F.length(m)).alias("end"),
                F.least(F.lit(1.0), F.lit(kind.score) + F.when(near(i), CONTEXT_BONUS).otherwise(0.0)).alias("score"),
                _valid(kind, m).alias("valid"),
            ),
        )
        kept = F.filter(every, lambda s: s["valid"] & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
        return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    # nothing is cut where no match can stand
    any_valid = F.exists(matches, lambda m: _valid(kind, m))
    return F.when(any_valid, F.transform(F.array(pieces), build)[0]).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans_<kind>`` for each kind: arrays of (kind, start, end, score)."""
    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = out.withColumns({k: v for kind in KINDS for k, v in _found(kind, "_text").items()})
    return found.select("doc_id", *[_spans(kind, "_text").alias(f"spans_{kind.name}") for kind in KINDS])


def report(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, the list of all spans, and their scores in the same order."""
    line = lambda name: F.transform(f"spans_{name}", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = [k.name for k in KINDS if k.base]
    return spans.select(
        "doc_id",
        *[F.size(f"spans_{name}").cast("long").alias(f"n_{name}") for name in base],
        F.sha2(F.array_join(F.concat(*[line(name) for name in base]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[line(k.name) for k in KINDS]), ",").alias("spans"),
        F.array_join(F.concat(*[F.transform(f"spans_{k.name}", lambda s: F.format_number(s["score"], 1)) for k in KINDS]), ",").alias("scores"),
        sum((F.size(f"spans_{k.name}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; every stretch of ``text`` that confirmed spans cover is replaced by a kind in brackets.

    All spans are those of ``detect`` on the text as it was.  Spans that overlap are one stretch, which takes the kind of
    the span that begins first (the longest of those, then the first in KINDS).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn("_text", text).withColumns({k: v for kind in KINDS for k, v in _found(kind, "_text").items()})
    # begin, length below zero and kind number of each span, in the order in which a stretch takes its kind
    rows = [_numbered(_spans(kind, "_text"), k) for k, kind in enumerate(KINDS)]
    spans = found.withColumn("_spans", F.sort_array(F.concat(*rows)))
    out = spans.withColumn("text", F.when(F.size("_spans") > 0, _masked(F.col("_text"), F.col("_spans"))).otherwise(F.col("text").cast("string")))
    return out.select(*docs.columns)


def _numbered(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("back"), F.lit(k).alias("kind")))


def _bound(value: Column, build) -> Column:
    """``build(value)`` with the value computed once."""
    return F.transform(F.array(value), build)[0]


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with the stretches under sorted ``spans`` masked."""
    marks = F.array(*[F.lit(f"[{kind.name.upper()}]") for kind in KINDS])

    def stretches(x: Column) -> Column:
        # where as many spans have ended as have begun, a stretch ends: the k-th end is not after the next begin
        n = F.size(x["s"])
        last = F.filter(F.sequence(F.lit(1), n), lambda k: (k == n) | (F.element_at(x["e"], k) <= F.element_at(x["s"], F.least(k + 1, n))["start"]))
        return _bound(last, lambda at: F.transform(at, lambda k, i: F.struct(_opens(x, at, i).alias("open"), F.element_at(x["e"], k).alias("end"))))

    def _opens(x: Column, at: Column, i: Column) -> Column:
        return F.element_at(x["s"], F.when(i == 0, 1).otherwise(F.element_at(at, F.greatest(i, F.lit(1))) + 1))

    def woven(cut: Column) -> Column:
        said = F.transform(cut, lambda c, i: F.concat(_between(F.when(i == 0, F.lit(0)).otherwise(F.element_at(cut, F.greatest(i, F.lit(1)))["end"]), c["open"]["start"]), F.element_at(marks, c["open"]["kind"] + 1)))
        return F.concat(F.array_join(said, ""), _between(F.element_at(cut, -1)["end"], F.length(text)))

    def _between(start: Column, end: Column) -> Column:
        return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))

    both = F.struct(spans.alias("s"), F.sort_array(F.transform(spans, lambda s: s["start"] - s["back"])).alias("e"))
    return _bound(_bound(both, stretches), woven)
