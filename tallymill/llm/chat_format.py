"""Conversations of many layouts as canonical turns, formatted with a loss mask and read back.

A layout is told by its schema. The nested paths of all fields (``messages[].role``) are
reduced to those that some mapping knows, sorted and hashed; this fingerprint selects a
declarative mapping: which paths hold roles and texts, in which order, and what roles are
called. A table has one fingerprint, that of its schema, and its mapping becomes column
expressions. In a column of JSON texts each record has its own. Fields that no mapping knows do
not change a fingerprint; an optional field has one fingerprint with it and one without.
Nothing is guessed: what matches no mapping is an error for a table, and for a record a row
without layout and turns, with its fingerprint.

The template writes a turn as ``### role``, a line break, the text, a line break and
``</turn>``. Inside roles and texts a backslash and the two marks are escaped, so marks in
the output are always the template's own and every text can be had back. Each turn is a row of
the output, in files ordered by conversation and turn, with the span of its text, in code points,
if the loss counts it (the assistant's). A conversation is the concatenation of its rows, so a
very long one is written by many tasks. Reading back streams the rows of a conversation past
running digests and holds none; a digest can only be taken in order, so the one task that does it
reads the whole conversation.

Defined cases: a null text or role is empty. A null conversation id is one conversation. Null
turns come first; rows of equal turn are ordered by hashes of role and text, and repeated rows
are turns of their own. Columns that no mapping knows are not looked at. A record without turns
(an empty list of messages) is no row of the output. An empty table gives an empty output. JSON
that is no object has no fingerprint.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "assistant"
HEAD, TAIL = "### ", "\n</turn>\n"
MARKS = {"\\": "\\\\", "###": "\\h", "</turn>": "\\c"}
#: A role is one line.
ROLE_MARKS = {**MARKS, "\n": "\\n"}
ESCAPED = {after: before for before, after in ROLE_MARKS.items()}
TURN = re.compile(r"### ([^\n]*)\n(.*?)\n</turn>\n", re.DOTALL)

CHAT = "conv_id long, turn long, formatted string, loss_start int, loss_end int"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
Step = tuple[str, str]  # role and where its text is


@dataclass(frozen=True)
class Layout:
    """How a layout becomes turns.

    ``items`` names a list whose elements hold ``role`` and ``text``; without it, ``steps`` lists
    a role and the paths of its text, joined by blank lines, for each turn of a record. With
    ``order``, each record is one turn itself. ``roles`` renames roles.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    steps: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        if self.items:
            return {self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}", *self.optional}
        if self.order:
            return {self.order, self.role, self.text}
        return {path for _, texts in self.steps for path in texts}

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for left_out in combinations(self.optional, n):
                yield fingerprint(self.paths().difference(left_out))


SPOKEN = (("human", "user"), ("gpt", ASSISTANT), ("bot", ASSISTANT), ("model", ASSISTANT))
LAYOUTS = (
    Layout("turn rows", order="turn", role="role", text="text"),
    Layout("messages", items="messages", role="role", text="content", optional=("system",), roles=SPOKEN),
    Layout("conversations", items="conversations", role="from", text="value", optional=("system",), roles=SPOKEN),
    Layout(
        "instruction",
        steps=(("system", ("system",)), ("user", ("instruction", "input")), (ASSISTANT, ("output",))),
        optional=("system", "input"),
    ),
    Layout(
        "prompt and completion",
        steps=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("completion",))),
        optional=("system",),
    ),
    Layout(
        "prompt and response",
        steps=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("response",))),
        optional=("system",),
    ),
    Layout(
        "question and answer",
        steps=(("system", ("system",)), ("user", ("question",)), (ASSISTANT, ("answer",))),
        optional=("system",),
    ),
)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(layouts: Sequence[Layout] = LAYOUTS) -> tuple[set[str], dict[str, Layout]]:
    """The paths that some layout knows, and the layout of each fingerprint."""
    known = set().union(*[layout.paths() for layout in layouts])
    found: dict[str, Layout] = {}
    for layout in layouts:
        for mark in layout.fingerprints():
            if mark in found:
                raise ValueError(f"{layout.name} cannot be told from {found[mark].name}")
            found[mark] = layout
    return known, found


def schema_paths(kind: T.DataType, before: str = "") -> set[str]:
    """Nested field paths of a type; elements of lists are below ``[]``."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{before}[]")
    if not isinstance(kind, T.StructType):
        return set()
    found = set()
    for part in kind.fields:
        path = f"{before}.{part.name}" if before else part.name
        found |= {path, *schema_paths(part.dataType, path)}
    return found


def value_paths(value: object, before: str = "") -> set[str]:
    """As :func:`schema_paths`, of a JSON value; fields that are null do not count."""
    found = set()
    if isinstance(value, list):
        for element in value:
            found |= value_paths(element, f"{before}[]")
    elif isinstance(value, dict):
        for name, inner in value.items():
            if inner is not None:
                path = f"{before}.{name}" if before else name
                found |= {path, *value_paths(inner, path)}
    return found


def layout_of(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Layout:
    known, found = registry(layouts)
    paths = schema_paths(df.schema) & known
    layout = found.get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    return layout


def _named(role: Column, layout: Layout) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in layout.roles:
        role = F.when(role == old, new).otherwise(role)
    return role


def turns_of(df: DataFrame, key: str = "conv_id", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table, by the mapping that its schema selects."""
    layout = layout_of(df, layouts)
    key_column = F.col(f"`{key}`").cast("long").alias("conv_id")
    empty = F.lit("")
    if layout.order:
        return df.select(
            key_column,
            F.col(layout.order).cast("long").alias("turn"),
            _named(F.col(layout.role), layout).alias("role"),
            F.coalesce(F.col(layout.text).cast("string"), empty).alias("text"),
        )

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text.cast("string"), empty).alias("text"))

    if layout.items:
        listed = F.coalesce(F.col(layout.items), F.array())
        turns = F.transform(
            listed, lambda x: turn(_named(x[layout.role], layout), x[layout.text])
        )
        if "system" in layout.optional and "system" in df.columns:
            given = F.array(turn(F.lit("system"), F.col("system")))
            turns = F.when(F.col("system").isNull(), turns).otherwise(F.concat(given, turns))
    else:
        made = []
        for role, paths in layout.steps:
            there = [F.col(path) for path in paths if path in df.columns]
            if there:
                filled = F.filter(F.array(*there), lambda x: x.isNotNull() & (x != ""))
                said = turn(F.lit(role), F.array_join(filled, "\n\n"))
                left_out = there[0].isNull() if set(paths) <= set(layout.optional) else F.lit(False)
                made.append(F.when(~left_out, said))
        turns = F.filter(F.array(*made), lambda x: x.isNotNull())
    return df.select(key_column, F.posexplode(turns).alias("turn", "said")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text"
    )


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def record_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """The turns of a JSON record, as :func:`turns_of` makes them."""
    renamed = dict(layout.roles)
    if layout.order:
        return [(_text(record.get(layout.role)), _text(record.get(layout.text)))]
    if layout.items:
        turns = [("system", _text(record["system"]))] if record.get("system") is not None else []
        for item in record[layout.items]:
            role = _text(item.get(layout.role))
            turns.append((renamed.get(role, role), _text(item.get(layout.text))))
        return turns
    turns = []
    for role, paths in layout.steps:
        if set(paths) <= set(layout.optional) and record.get(paths[0]) is None:
            continue
        filled = [_text(record[path]) for path in paths if record.get(path) not in (None, "")]
        turns.append((role, "\n\n".join(filled)))
    return turns


def records_of(
    df: DataFrame, key: str = "conv_id", body: str = "body", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of a column of JSON texts, a layout for each record.

    ``turns`` is an array of (turn, role, text). Records of no layout have null there, and texts
    that are no object have no fingerprint either.
    """
    source = df.select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{body}`").alias("body"))
    schema = (
        "conv_id long, fingerprint string, layout string, "
        "turns array<struct<turn: long, role: string, text: string>>"
    )
    known, by_mark = registry(layouts)

    def read(body: str | None) -> tuple[str | None, str | None, list | None]:
        try:
            record = json.loads(body or "")
        except ValueError:
            return None, None, None
        if not isinstance(record, dict):
            return None, None, None
        mark = fingerprint(value_paths(record) & known)
        layout = by_mark.get(mark)
        if layout is None:
            return mark, None, None
        order = record[layout.order] if layout.order else 0
        first = order if isinstance(order, int) else 0
        turns = enumerate(record_turns(record, layout), first)
        return mark, layout.name, [{"turn": n, "role": role, "text": text} for n, (role, text) in turns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            found = list(zip(*map(read, batch.column("body").to_pylist()))) or [()] * 3
            kinds = (pa.string(), pa.string(), pa.list_(turn))
            made = [pa.array(column, kind) for column, kind in zip(found, kinds)]
            names = ["conv_id", "fingerprint", "layout", "turns"]
            yield pa.record_batch([batch.column("conv_id"), *made], names)

    return source.mapInArrow(run, schema)


def turns_of_records(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of records with a layout."""
    return records.select("conv_id", F.explode("turns").alias("said")).select("conv_id", "said.*")


def _escaped(text: Column, marks: dict[str, str]) -> Column:
    for before, after in marks.items():
        text = F.replace(text, F.lit(before), F.lit(after))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\.", lambda found: ESCAPED[found.group()], text) if "\\" in text else text


def formatted(turns: DataFrame) -> DataFrame:
    """CHAT rows and a number that orders equal turns."""
    head = F.concat(F.lit(HEAD), _escaped(F.col("role"), ROLE_MARKS), F.lit("\n"))
    body = _escaped(F.col("text"), MARKS)
    start = F.length("head").cast("int")
    counts = F.col("role") == ASSISTANT
    return turns.select(
        "conv_id", "turn", "role", head.alias("head"), body.alias("body"),
        F.xxhash64("role", "text").alias("tie"),
    ).select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(TAIL)).alias("formatted"),
        F.when(counts, start).alias("loss_start"),
        F.when(counts, start + F.length("body").cast("int")).alias("loss_end"),
        "tie",
    )


def write_chat(turns: DataFrame, path: str) -> None:
    """Write formatted turns below ``path``, in the order of conversation and turn."""
    order = ["conv_id", "turn", "tie"]
    rows = formatted(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.parquet(path)


def parsed(conversation: str) -> list[tuple[str, str]]:
    """Role and text of the turns of formatted text."""
    return [(unescaped(role), unescaped(text)) for role, text in TURN.findall(conversation)]


class Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, loss_start: int | None, loss_end: int | None) -> None:
        for role, said in parsed(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        if loss_start is not None:
            said = unescaped(text[loss_start:loss_end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        found = (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest())
        return (*found, self.chars)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGESTS of rows ordered by conversation and turn."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    current, digest = None, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        done = []
        columns = [batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end")]
        for conv_id, text, start, end in zip(*columns):
            if digest is None or conv_id != current:
                if digest is not None:
                    done.append((current, *digest.row()))
                current, digest = conv_id, Digest()
            digest.add(text, start, end)
        yield table(done)
    if digest is not None:
        yield table([(current, *digest.row())])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of stored chats."""
    rows = spark.read.parquet(path)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie").drop("turn", "tie")
    return ordered.mapInArrow(_digested, DIGESTS)
