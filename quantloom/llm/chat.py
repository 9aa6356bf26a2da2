r"""Chat formatting: layouts told by schema fingerprints, turns in a reversible template.

Rows of different layouts (a prompt and a response, an instruction with input, message
lists, one row per turn) are brought to canonical turns. A *mapping* declares for one
layout its required and optional nested field paths, and how turns come from them. The
fingerprint of a set of paths is the SHA-256 of its sorted names. The schema's fingerprints
select the mappings; in a table of several layouts a row's own fingerprint, over the
fields that it has, selects among them. Columns of other layouts, and others, don't count.

Template: ``<turn>role\ntext</turn>\n`` for each turn. Inside roles and texts ``\`` is
written ``\\`` and ``<`` is written ``\l`` (in roles a line feed is ``\n``), so that no
text can hold a marker, and reading back gives the exact text. The loss mask has one
span of code points per assistant turn.

Built-in functions only. Turns are escaped and measured row by row before they are
gathered; what is gathered is one conversation, which is one row of the output by
definition of the format.

Defined cases: a null text or role is empty, as are a null prompt, instruction, input,
response and the like; ties in the turn number are ordered by role and text, repeated rows
stay repeated turns, a null turn comes first; null conversation ids form one conversation;
rows of no known layout and rows with a null or empty list of messages give no turn, but
their conversation stays, with an empty text if it has no other turn (``unmapped`` returns
the rows of no layout); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

OPEN, CLOSE, TRAINED = "<turn>", "</turn>\n", "assistant"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths: ``a.b`` for structs, ``a[].b`` through arrays, ``a{}.b`` through maps."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, f"{prefix}{{}}")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    """SHA-256 of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role, text) -> Column:
    blank = F.lit("")
    return F.struct(F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))


def _renamed(role: Column, names: dict[str, str]) -> Column:
    out = role
    for old, new in names.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and the array of turns that a row of it stands for."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[set[str]], Column]

    def fingerprints(self) -> list[str]:
        sets = (c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n))
        return [fingerprint((*self.required, *c)) for c in sets if self.required or c]

    def paths(self) -> set[str]:
        return {*self.required, *self.optional}


def _pair(first: str, answer: str, extra: str = "") -> Callable[[set[str]], Column]:
    def turns(have: set[str]) -> Column:
        asked = F.coalesce(F.col(first), F.lit(""))
        if extra in have:
            more = F.coalesce(F.col(extra), F.lit(""))
            asked = F.when(more == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), more))
        out = [F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), F.col(answer)))]
        if "system" in have:
            out.insert(0, F.when(F.col("system").isNull(), F.array().cast("array<struct<role:string,text:string>>"))
                       .otherwise(F.array(_turn(F.lit("system"), F.col("system")))))
        return F.concat(*out)

    return turns


#: The layouts known from the start; callers may pass their own.
MAPPINGS = (
    Mapping("turn_rows", (), ("role", "text"), lambda have: F.array(_turn(
        F.col("role") if "role" in have else F.lit(None), F.col("text") if "text" in have else F.lit(None)))),
    Mapping("messages", ("messages[].content", "messages[].role"), ("system",), lambda have: F.concat(
        F.when(F.col("system").isNotNull(), F.array(_turn(F.lit("system"), F.col("system"))))
        .otherwise(F.array().cast("array<struct<role:string,text:string>>")) if "system" in have
        else F.array().cast("array<struct<role:string,text:string>>"),
        F.transform("messages", lambda m: _turn(m["role"], m["content"])))),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), (), lambda have: F.transform(
        "conversations", lambda m: _turn(
            _renamed(m["from"], {"human": "user", "gpt": "assistant"}), m["value"]))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), _pair("prompt", "response")),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), _pair("prompt", "completion")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), _pair("instruction", "output", "input")),
    Mapping("question_answer", ("question", "answer"), ("system",), _pair("question", "answer")),
)


def candidates(schema: T.StructType, mappings: Iterable[Mapping] = MAPPINGS) -> list[Mapping]:
    """The mappings that the schema's fingerprints select, those of most required paths first.

    A mapping is selected if the fingerprint of the schema's paths that it knows is one of
    its own; paths of no concern to it don't count.
    """
    have = set(field_paths(schema))
    hit = [m for m in mappings if fingerprint(have & m.paths()) in m.fingerprints()]
    return sorted(hit, key=lambda m: -len(m.required))


def _top(path: str) -> str:
    return path.split(".")[0].split("[")[0].split("{")[0]


def row_fingerprint(have: Iterable[str], mapping: Mapping) -> Column:
    """SHA-256 over those of the mapping's paths whose top field is not null in the row."""
    known = sorted(mapping.paths() & set(have))
    there = [F.when(F.col(f"`{_top(p)}`").isNotNull(), F.lit(p)) for p in known]
    return F.sha2(F.array_join(F.array(*there), "\n"), 256)


def canonical_turns(df: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """``df`` with ``_layout`` (name of the mapping, null if none) and ``_turns`` (array of role and text).

    A table whose schema selects one mapping follows it in every row, nulls being empty.
    In a table of several layouts a row follows the first one that its own fingerprint
    selects, else the one of whose required fields it has most (of equal ones the first);
    a row with no field of any layout has none.
    """
    have = set(field_paths(df.schema))
    fits = candidates(df.schema, mappings)
    none = F.array().cast("array<struct<role:string,text:string>>")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    if len(fits) == 1:
        layout, turns = F.lit(fits[0].name), fits[0].turns(have)
    elif fits:
        count = lambda m: sum((F.col(f"`{_top(p)}`").isNotNull().cast("int") for p in (m.required or m.optional) if p in have), F.lit(0))
        most = F.greatest(*map(count, fits))
        rules = [(row_fingerprint(have, m).isin(m.fingerprints()), m) for m in fits] + [((most > 0) & (count(m) == most), m) for m in fits]
        for hit, m in reversed(rules):
            layout = F.when(hit, F.lit(m.name)).otherwise(layout)
            turns = F.when(hit, m.turns(have)).otherwise(turns)
    return df.withColumn("_layout", layout).withColumn("_turns", F.coalesce(turns, none))


def unmapped(df: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """The rows whose layout no mapping declares; ``format_chats`` keeps them as conversations without turns."""
    return canonical_turns(df, mappings).where(F.col("_layout").isNull()).drop("_layout", "_turns")


def escape(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_feeds else out


def unescape(text: Column, line_feeds: bool = False) -> Column:
    def part(x: Column) -> Column:
        out = F.replace(x, F.lit("\\l"), F.lit("<"))
        return F.replace(out, F.lit("\\n"), F.lit("\n")) if line_feeds else out

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_chats(
    df: DataFrame, conv_id: str = "conv_id", turn: str | None = "turn", mappings: Iterable[Mapping] = MAPPINGS
) -> DataFrame:
    """One row per conversation: the id, ``formatted`` and ``mask``, an array with a struct per
    turn: start of the turn, start and end (excluded) of its text under the loss mask, in
    code points of ``formatted``; null start and end where the turn is not trained on."""
    order = F.col(turn) if turn else F.lit(0)
    rows = canonical_turns(df.drop("_layout", "_turns"), mappings).select(
        F.col(conv_id).alias("_id"), order.alias("_turn"), F.posexplode_outer("_turns").alias("_k", "t")
    )
    role, text = escape(F.col("t.role"), True), escape(F.col("t.text"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    by = Window.partitionBy("_id").orderBy("_turn", "_k", "role", "text")
    flat = (
        rows.select(
            "_id", "_turn", "_k", F.col("t.role").alias("role"), F.col("t.text").alias("text"),
            F.concat(head, text, F.lit(CLOSE)).alias("segment"),
            F.length(head).alias("before"), F.length(text).alias("inside"),
        )
        .withColumn("pos", F.row_number().over(by))
        .withColumn("start", F.sum(F.coalesce(F.length("segment"), F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment"))
    )
    trained = F.col("role") == TRAINED
    at = F.col("start") + F.col("before")
    turn_row = F.when(F.col("segment").isNotNull(), F.struct(
        "pos",
        "segment",
        F.struct(
            "start", F.when(trained, at).alias("loss_start"), F.when(trained, at + F.col("inside")).alias("loss_end")
        ).alias("m"),
    ))
    return (
        flat.groupBy("_id")
        .agg(F.sort_array(F.collect_list(turn_row)).alias("x"))
        .select(
            F.col("_id").alias(conv_id),
            F.array_join(F.transform("x", lambda x: x["segment"]), "").alias("formatted"),
            F.transform("x", lambda x: x["m"]).alias("mask"),
        )
    )


def read_back(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """From the output alone: the id, ``formatted``, ``turns`` (role and text) and
    ``loss_texts``, the unescaped texts under the loss mask in order."""

    def parsed(seg: Column) -> Column:
        head = F.substring_index(seg, "\n", 1)
        after = F.length(head) + 2
        body = F.substr(seg, after, F.length(seg) - after + 1 - len(CLOSE))
        return F.struct(unescape(head, True).alias("role"), unescape(body).alias("text"))

    def under_mask(seg: Column, m: Column) -> Column:
        # a segment stands without its opening marker here
        at = m["loss_start"] - m["start"] - len(OPEN) + 1
        return unescape(F.substr(seg, at.cast("int"), (m["loss_end"] - m["loss_start"]).cast("int")))

    segments = F.slice(F.split("formatted", OPEN, -1), F.lit(2), F.size("mask"))
    return formatted.select(
        conv_id,
        "formatted",
        let(segments, lambda x: F.transform(x, parsed)).alias("turns"),
        F.filter(
            let(segments, lambda x: F.zip_with(x, "mask", under_mask)), lambda x: x.isNotNull()
        ).alias("loss_texts"),
    )
