"""Operator 8: heterogeneous chat records to canonical turns and a reversible template.  Native functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of the template (fixed values).
BEGIN, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: JSON text below so many bytes holds no string or record over a limit of try_parse_json,
#: which gives null for one: 20,000,000 characters a string, 128 MiB a record.
JSON_BYTES = 20_000_000


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``shape`` is the record's nested field paths, sorted, without scalar types.  Either
    ``messages`` names an array of objects with fields ``role`` and ``text``, or ``turns``
    lists (role, paths); the texts at several paths are joined by an empty line.
    """

    name: str
    shape: str
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", messages="messages"),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", messages="conversations",
           role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", "OBJECT<completion, prompt>", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt", "OBJECT<completion, prompt, system>",
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", "OBJECT<instruction, output>", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", "OBJECT<input, instruction, output>",
           turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def shape(record: Column) -> Column:
    """Nested field paths of a variant, as text: objects, arrays and sorted field names."""
    return F.regexp_replace(F.schema_of_variant(record), ": (?!OBJECT|ARRAY)[A-Z][A-Z_]*(\\([0-9,]*\\))?", "")


def typed_shape(kind: T.DataType) -> str:
    """Nested field paths of a column's type, as ``shape`` writes those of a variant."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{typed_shape(kind.elementType)}>"
    if not isinstance(kind, T.StructType):
        return kind.simpleString().upper()
    named = [(f.name if re.fullmatch(r"(?!\d+$)\w+", f.name, re.ASCII) else "`" + f.name.replace("`", "``") + "`", f.dataType)
             for f in sorted(kind.fields, key=lambda f: f.name.encode())]
    nested = (T.ArrayType, T.StructType)
    return "OBJECT<" + ", ".join(f"{n}: {typed_shape(t)}" if isinstance(t, nested) else n for n, t in named) + ">"


def parsed(json: Column) -> Column:
    """The variant of a JSON text; null for broken JSON, and an error for one that may be too large to parse."""
    record, size = F.try_parse_json(json), F.octet_length(json)
    message = F.concat(F.lit("chat record of "), size.cast("string"), F.lit(
        " bytes is broken or over the limits of the JSON parser (20,000,000 characters a string, 128 MiB a record); "
        "give such records as a struct column"))
    return F.when(record.isNull() & (size >= JSON_BYTES), F.raise_error(message).cast("variant")).otherwise(record)


def _field(record: Column, path: str, kind: str, typed: bool) -> Column:
    return record[path].cast(kind) if typed else F.try_variant_get(record, f"$.{path}", kind)


def _turns(record: Column, layout: Layout, typed: bool = False) -> Column:
    if layout.messages:
        items = record[layout.messages] if typed else F.try_variant_get(
            record, f"$.{layout.messages}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")

        def named(role: Column) -> Column:
            out = role
            for old, new in layout.roles.items():
                out = F.when(role == old, new).otherwise(out)
            return out

        return F.transform(items, lambda m: F.struct(
            F.coalesce(named(m[layout.role].cast("string")), F.lit("")).alias("role"),
            F.coalesce(m[layout.text].cast("string"), F.lit("")).alias("text")))
    made = []
    for role, paths in layout.turns:
        texts = [_field(record, p, "string", typed) for p in paths]
        text = F.array_join(F.filter(F.array(*texts), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
        made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*made)


def canonical_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """Name of the layout that a record's fingerprint selects, and its turns; null for an unknown shape."""
    fingerprint = F.xxhash64(shape(record))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        fits = fingerprint == F.xxhash64(F.lit(layout.shape))
        name = F.when(fits, layout.name).otherwise(name)
        turns = F.when(fits, _turns(record, layout)).otherwise(turns)
    return name, turns.cast(TURNS)


def typed_turns(record: Column, kind: T.DataType, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """``canonical_turns`` of a struct column of type ``kind``, without JSON or variant."""
    for layout in layouts:
        if layout.shape == typed_shape(kind):
            fits = record.isNotNull()
            return F.when(fits, layout.name), F.when(fits, _turns(record, layout, typed=True)).cast(TURNS)
    return F.lit(None).cast("string"), F.lit(None).cast(TURNS)


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("<%7C"))
    return F.replace(out, F.lit("\n"), F.lit("%0A")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("%0A"), F.lit("\n")), F.lit("<%7C"), F.lit("<|"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def format_chats(records: DataFrame, key: str, record: str | tuple[str, ...], layouts: tuple[Layout, ...] = LAYOUTS,
                 learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format records of any known layout by one template, with a loss mask.

    ``record`` names a column of JSON texts or of structs, or several columns, one for
    each type of record; a row's record is the first that is not null.  The nested field
    paths of a JSON record, by their hash, or of a struct type select a layout, whose
    mapping yields the turns.  A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.
    In roles and texts ``%`` becomes ``%25`` and ``<|`` becomes ``<%7C`` (in roles also a
    line feed ``%0A``), so no text can hold a mark, and ``read_back`` undoes it.

    Result: key, layout, formatted, and loss: spans (code points, end exclusive) of the
    texts of ``learned`` roles.  One row per input row; repeated rows stay.  Null, broken
    JSON and unknown shapes give null layout, formatted and loss; missing texts are
    empty; a list without items gives an empty string.  Other columns are ignored.
    Texts of structs may be of any size that a row can hold.  JSON of JSON_BYTES or more
    that does not parse, as it is broken or over the parser's limits, is an error.
    """
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for column in reversed((record,) if isinstance(record, str) else record):
        kind, given = records.schema[column].dataType, F.col(column)
        found = typed_turns(given, kind, layouts) if isinstance(kind, T.StructType) else canonical_turns(parsed(given), layouts)
        name, turns = (F.when(given.isNotNull(), new).otherwise(old) for new, old in zip(found, (name, turns)))
    rows = records.select(F.col(key), name.alias("layout"), turns.alias("turns"))
    parts = rows.withColumn("parts", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(BEGIN), escape(t["role"], role=True), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), t["role"].isin(*learned).alias("learn"))))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    ends = F.aggregate(
        F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + F.lit(len(END) + 1)),
        F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    spans = F.zip_with("parts", ends, lambda p, at: F.struct(
        (at + F.char_length(p["head"])).alias("start"),
        (at + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"), p["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"]))
    return parts.select(key, "layout", whole.alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(BEGIN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.char_length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def conversation_records(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation from rows by turn: the struct ``pair`` of prompt and completion for a plain question
    and answer, else the struct ``many`` of messages; the other is null.  Ties of a turn are ordered by role, then text;
    null turns come first, null texts are empty.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = turns.groupBy(F.col(conversation).alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    plain = (F.size("rows") == 2) & (F.col("rows")[0]["role"] == "user") & (F.col("rows")[1]["role"] == "assistant")
    pair = F.struct(F.col("rows")[0]["content"].alias("prompt"), F.get("rows", F.lit(1))["content"].alias("completion"))
    many = F.struct(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))
    return grouped.select(F.col("key"), F.when(plain, pair).alias("pair"), F.when(~plain, many).alias("many"))
