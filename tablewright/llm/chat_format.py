"""Chat formatting: records of many layouts become canonical turns, and turns become one marked text.

A record's layout is the set of nested field paths that hold a value, out of those that one mapping names: of the mappings
whose needed paths all hold a value, if it is only one; else of the turn rows. Its hash selects the declarative mapping that says where roles
and texts stand. The template marks each turn and escapes its
control strings inside roles and texts with a backslash, so the formatted text can be read back exactly. The loss
mask covers the texts of the assistant's turns.

A null text is empty, a null role is the empty role, a null turn number comes first, a null conversation id is one
conversation; equal turn numbers are ordered by role and text, repeated rows are repeated turns. A record with an
unknown layout keeps its fingerprint and has no turns; where the table has turn rows (a role or a text), none is unknown. Extra
columns are ignored, also those named like a path of a mapping that the record does not fill; to pin a layout pass its
mapping alone. Roles stay as they are, save those of layouts that have names of their own for them. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings.
HEADER, CLOSE = "### ", " </turn>\n"
ESCAPED = re.compile(r"\\|###|</turn>")
IN_HEADER = re.compile(r"\\(?:\\|###|</turn>|: )|: ")
IN_TEXT = re.compile(r"\\(?:\\|###|</turn>)| </turn>\n")
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Field:
    """A turn from two flat fields or one: its role (a path or, with ``fixed``, a word) and the paths whose texts are joined by line ends."""

    role: str
    texts: tuple[str, ...]
    fixed: bool = True


@dataclass(frozen=True)
class Mapping:
    """A layout: paths that a record must have and may have; where its turns stand.

    ``fields`` gives turns from flat fields; ``items`` names an array of structs with the fields ``role`` and ``text``.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    items: str | None = None
    role: str | None = None
    text: str | None = None
    own_roles: bool = False

    def layouts(self) -> Iterator[tuple[str, ...]]:
        for n in range(len(self.may) + 1):
            for some in itertools.combinations(self.may, n):
                yield tuple(sorted(self.needs + some))


#: Names of the three roles in layouts that have their own.
ROLES = {"human": "user", "prompter": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}

MAPPINGS = (
    Mapping("turn rows", (), ("conv_id", "turn", "role", "text"), (Field("role", ("text",), fixed=False),)),
    Mapping("prompt and response", ("prompt", "response"), ("system",), (Field("system", ("system",)), Field("user", ("prompt",)), Field(ASSISTANT, ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input",), (Field("user", ("instruction", "input")), Field(ASSISTANT, ("output",)))),
    Mapping("messages", ("messages[].role", "messages[].content"), (), items="messages", role="role", text="content"),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), (), items="conversations", role="from", text="value", own_roles=True),
)


def _any_has(items: Column, inner: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x[inner].isNotNull()), F.lit(False))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _item_turns(m: Mapping) -> Column:
    return F.transform(F.col(f"`{m.items}`"), lambda x: _turn(x[m.role].cast("string"), x[m.text].cast("string")))


def _paths(schema: T.StructType) -> dict[str, Column]:
    """Each nested path of the schema, with whether a record has a value there."""
    out: dict[str, Column] = {}
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            for inner in field.dataType.elementType.names:
                out[f"{field.name}[].{inner}"] = _any_has(value, inner)
        elif isinstance(field.dataType, T.StructType):
            for inner in field.dataType.names:
                out[f"{field.name}.{inner}"] = value[inner].isNotNull()
        else:
            out[field.name] = value.isNotNull()
    return out


def _fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _usable(df: DataFrame, mappings: tuple[Mapping, ...]) -> list[tuple[Mapping, Column]]:
    """The mappings that the table's columns allow, and whether a record is of each: the only one it holds all needed paths of.

    A mapping without needed paths, which come last, takes the records that are of no other.
    """
    held = _paths(df.schema)
    fit = [m for m in mappings if set(m.needs) <= set(held) and set(m.needs + m.may) & set(held)]
    whole = lambda m: reduce(lambda x, y: x & y, [held[p] for p in m.needs], F.lit(True))
    told = [m for m in fit if m.needs]
    count = reduce(lambda x, y: x + y, [whole(m).cast("int") for m in told], F.lit(0))
    return [(m, whole(m) & (count == 1)) for m in told] + [(m, F.lit(True)) for m in fit if not m.needs]


def layout_fingerprint(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hash of the sorted paths that hold a value, among those of the mapping that fits best (of all, if none does)."""
    held = _paths(df.schema)
    among = lambda paths: F.array_compact(F.array(*(F.when(held[p], F.lit(p)) for p in sorted(set(paths) & set(held))), F.lit(None).cast("string")))
    layout = among([p for m in mappings for p in m.needs + m.may])
    for m, whole in reversed(_usable(df, mappings)):
        layout = F.when(whole, among(m.needs + m.may)).otherwise(layout)
    return _fingerprint(layout)


def canonical_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with ``_layout`` (fingerprint), ``_mapping`` (name or null) and ``_turns`` (array of role, text)."""
    have = set(_paths(df.schema))
    turns = F.array().cast("array<struct<role: string, text: string>>")
    name = F.lit(None).cast("string")
    text = lambda path: F.col(f"`{path}`").cast("string")
    for m, whole in reversed(_usable(df, mappings)):
        if m.items:
            made = _item_turns(m)
        else:
            made = F.array()
            parts = []
            for field in m.fields:
                there = [p for p in field.texts if p in have]
                said = F.concat_ws("\n", *(text(p) for p in there)) if there else F.lit("")
                role = F.lit(field.role) if field.fixed else text(field.role) if field.role in have else F.lit("")
                always = not field.fixed or bool(set(field.texts) & set(m.needs))
                there_now = F.lit(True) if always else F.coalesce(*(text(p) for p in there)).isNotNull() if there else F.lit(False)
                parts.append(F.when(there_now, _turn(role, said)))
            made = F.array_compact(F.array(*parts))
        prints = [_fingerprint(F.array(*(F.lit(p) for p in layout)) if layout else F.array().cast("array<string>")) for layout in m.layouts()]
        if m.own_roles:
            made = F.transform(made, lambda x: F.struct(F.coalesce(F.create_map(*(F.lit(w) for kv in ROLES.items() for w in kv))[x["role"]], x["role"]).alias("role"), x["text"].alias("text")))
        fits = whole & F.col("_layout").isin(prints)
        turns, name = F.when(fits, made).otherwise(turns), F.when(fits, m.name).otherwise(name)
    return df.withColumn("_layout", layout_fingerprint(df, mappings)).withColumn("_turns", turns).withColumn("_mapping", name)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|: )", lambda m: m[1], text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and the place of its text there."""
    head = HEADER + escape(role).replace(": ", "\\: ") + ": "
    said = escape(text)
    return head + said + CLOSE, len(head), len(head) + len(said)


def _until(pattern: re.Pattern, formatted: str, start: int) -> re.Match | None:
    """The next control string that no backslash escapes."""
    return next((m for m in pattern.finditer(formatted, start) if m[0][0] != "\\"), None)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text (or of any of its whole turns)."""
    turns: list[tuple[str, str]] = []
    place = 0
    while formatted.startswith(HEADER, place):
        colon = _until(IN_HEADER, formatted, place + len(HEADER))
        close = colon and _until(IN_TEXT, formatted, colon.end())
        if not close:
            break
        turns.append((unescape(formatted[place + len(HEADER) : colon.start()]), unescape(formatted[colon.end() : close.start()])))
        place = close.end()
    return turns


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv, part, formatted, loss_start, loss_end): the conversations as marked text, one row per turn.

    A conversation's text is its parts joined in order; a span of the loss mask is given in code points of its part,
    null for turns that aren't the assistant's. Parts of a conversation are adjacent and in order within one
    partition, and are made one after the other, so that no conversation is held whole.
    """
    number = F.col(turn_col) if turn_col in df.columns else F.lit(0)
    rows = canonical_turns(df, mappings).select(F.col(conv_col).alias("conv"), number.alias("number"), F.posexplode("_turns").alias("place", "said"))
    rows = rows.select("conv", "number", "place", "said.role", "said.text")
    # texts are ordered by their bytes, as everywhere in Spark
    rows = rows.repartition("conv").sortWithinPartitions("conv", "number", "place", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                last, part = conv, part + 1 if conv == last else 0
                formatted, start, end = marked(role, text)
                out.append((conv, part, formatted, *((start, end) if role == ASSISTANT else (None, None))))
            columns = list(zip(*out)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "part", "formatted", "loss_start", "loss_end"])

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, part long, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``format_turns``' rows.

    The rows have to come as ``format_turns`` gives them, in its order and its partitions; a part out of turn is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        open_: list = []
        expected = 0

        def done() -> pa.RecordBatch:
            conv, n, turns, loss, lost, chars = open_
            values = (conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars)
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, part, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part and (not open_ or part != expected):
                    raise ValueError("parts of a conversation have to be adjacent and in order")
                expected = part + 1
                if part == 0:
                    if open_:
                        ready.append(done())
                    open_[:] = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, said in read_turns(text):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    lost = unescape(text[start:end])
                    open_[3].update(lost.encode())
                    open_[4] += len(lost)
                open_[5] += len(text)
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if open_:
            yield done()

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
