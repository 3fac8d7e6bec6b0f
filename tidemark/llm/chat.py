"""Chat formatting by schema fingerprint.

The nested field paths of a table (or of a JSON document) are hashed; the hash selects a declarative mapping that turns
that layout (flat turns, prompt and completion, instruction and input, message lists) into canonical turns
``turns array<struct<role,text>>``.  ``format_turns`` writes turns into one string with turn marks and a loss mask,
``read_turns`` reads them back.  Everything is DataFrame functions.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text, so ties and
repeated rows have one order and all stay; rows with a null conversation id form one conversation; an empty table
gives an empty result; fields that no mapping names are ignored, also where their names clash with the output's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Every nested field path of a type, arrays written as []."""
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def fingerprint(fields: list[str]) -> str:
    """The hash of a set of field paths, the same for any order of fields."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role.cast("string"), F.lit(""))).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(field: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda col: F.coalesce(F.transform(col(field), lambda m: _turn(m[role], m[text])), F.array().cast(TURNS))


def _instruction(reply: str) -> Callable[[Callable[[str], Column]], Column]:
    def build(col: Callable[[str], Column]) -> Column:
        given = F.coalesce(col("input").cast("string"), F.lit(""))
        ask = F.concat(F.coalesce(col("instruction").cast("string"), F.lit("")), F.when(given == "", "").otherwise(F.concat(F.lit("\n\n"), given)))
        return F.array(_turn("user", ask), _turn("assistant", col(reply)))

    return build


def _said(ask: str, reply: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda col: F.array(_turn("user", col(ask)), _turn("assistant", col(reply)))


@dataclass(frozen=True)
class Layout:
    """How a row becomes turns; where ``order`` is given, a row is one turn of the conversation in its key."""

    fields: tuple[str, ...]
    build: Callable[[Callable[[str], Column]], Column]
    order: str | None = None


LAYOUTS = (
    Layout(("turn", "role", "text"), lambda col: F.array(_turn(col("role"), col("text"))), "turn"),
    Layout(("prompt", "completion"), _said("prompt", "completion")),
    Layout(("prompt", "response"), _said("prompt", "response")),
    Layout(("question", "answer"), _said("question", "answer")),
    Layout(("instruction", "output"), _said("instruction", "output")),
    Layout(("instruction", "input", "output"), _instruction("output")),
    Layout(("instruction", "input", "response"), _instruction("response")),
    Layout(("messages[].role", "messages[].content"), _messages("messages", "role", "content")),
    Layout(("messages[].from", "messages[].value"), _messages("messages", "from", "value")),
    Layout(("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    Layout(("conversations[].role", "conversations[].content"), _messages("conversations", "role", "content")),
)
#: The table of mappings, by the hash of a layout's field paths.
MAPPINGS = {fingerprint(list(x.fields)): x for x in LAYOUTS}
_KNOWN = {p for x in LAYOUTS for p in x.fields}


def schema_fingerprint(df: DataFrame, key: str = "conv_id") -> str:
    """The fingerprint of the table's known fields but its key; if that is no layout, of the largest layout among them."""
    found = {p for p in paths(df.schema) if p in _KNOWN and p != key}
    mark = fingerprint(list(found))
    inside = sorted((x for x in LAYOUTS if set(x.fields) <= found), key=lambda x: -len(x.fields))
    return mark if mark in MAPPINGS or not inside else fingerprint(list(inside[0].fields))


def to_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a table of any known layout."""
    found = MAPPINGS.get(schema_fingerprint(df, key))
    if found is None:
        raise ValueError(f"no mapping for the fields {sorted(paths(df.schema))}")
    said = found.build(F.col)
    if found.order is None:
        return df.select(F.col(key), said.alias("turns"))
    rows = df.select(F.col(key), F.struct(F.col(found.order).alias("at"), said[0]["role"].alias("role"), said[0]["text"].alias("text")).alias("row"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("row")).alias("rows")).select(key, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def _nested(doc: Column, field: str) -> Column:
    """The known paths under a list of objects, from the keys of all its elements; null if there is no such list.

    Keys that a list lacks throughout (an empty list lacks all) are filled up from the first layout that has the others.
    """
    layouts = [x.fields for x in LAYOUTS if x.order is None and x.fields[0].startswith(f"{field}[].")]
    names = [sorted(p.split("[].")[1] for p in fields) for fields in layouts]
    elements = F.from_json(F.get_json_object(doc, f"$.{field}"), "array<map<string,string>>")
    keys = F.array_intersect(F.flatten(F.transform(elements, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))), F.array(*[F.lit(n) for n in sorted({n for some in names for n in some})]))
    full = F.coalesce(*[F.when(F.size(F.array_except(keys, F.array(*map(F.lit, some)))) == 0, F.array(*map(F.lit, some))) for some in names], keys)
    return F.transform(full, lambda n: F.concat(F.lit(f"{field}[]."), n))


def json_to_turns(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, fingerprint, turns) of JSON documents whose layouts differ from row to row; turns is null where none is known."""
    doc = F.col(column)
    layouts = {mark: x for mark, x in MAPPINGS.items() if x.order is None}
    known = sorted({p for x in layouts.values() for p in x.fields})
    lists = sorted({p.split("[].")[0] for p in known if "[]." in p})
    none = F.array().cast("array<string>")
    top = F.array_intersect(F.coalesce(F.json_object_keys(doc), none), F.array(*[F.lit(p) for p in known if "[]." not in p]))
    found = F.concat(top, *[F.coalesce(_nested(doc, f), none) for f in lists])
    mark = F.substring(F.sha2(F.array_join(F.array_sort(found), "\n"), 256), 1, 16)
    inside = {f: sorted({p.split("[].")[1] for p in known if p.startswith(f"{f}[].")}) for f in lists}
    value = lambda f: F.from_json(F.get_json_object(doc, f"$.{f}"), f"array<struct<{','.join(f'`{n}`:string' for n in inside[f])}>>") if f in inside else F.get_json_object(doc, f"$.{f}")
    turns = F.coalesce(*[F.when(mark == k, x.build(value)) for k, x in layouts.items()])
    return df.select(F.col(key), mark.alias("fingerprint"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """Free of "<|" and one-to-one: a backslash becomes \\0 and "<|" becomes "<\\1|"."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\1|"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\2"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\2"), F.lit("\n")))


def format_turns(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, runs (chars, in_loss) that cover the string; assistants' texts are in the loss."""
    turn = lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("in_loss"))
    mask = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                run(F.length(_role_out(t["role"])) + len(OPEN) + 1, F.lit(False)),
                run(F.length(escape(t["text"])), t["role"] == "assistant"),
                run(F.lit(len(CLOSE)), F.lit(False)),
            ),
        )
    )
    return df.withColumns({"formatted": F.array_join(F.transform("turns", turn), ""), "loss_mask": mask})


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    return F.transform(F.transform(pieces, body), lambda b: F.struct(_role_in(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    The mask has three runs a turn; the first two lie inside the turn's piece of the string, so each text is cut out of
    its own piece by the mask's lengths, in time linear in the string.
    """
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    before, body = F.filter(mask, lambda _, i: i % 3 == 0), F.filter(mask, lambda _, i: i % 3 == 1)
    zipped = F.arrays_zip(pieces.alias("piece"), before.alias("before"), body.alias("body"))
    lost = F.filter(zipped, lambda z: z["body"]["in_loss"])
    return F.transform(lost, lambda z: unescape(F.substr(z["piece"], (z["before"]["chars"] + 1).cast("int"), z["body"]["chars"].cast("int"))))


def digests(df: DataFrame) -> DataFrame:
    """conv_id and the digests of what ``read_turns`` and the loss mask get back from ``formatted``."""
    back = df.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("back"), F.array_join(under_mask(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
