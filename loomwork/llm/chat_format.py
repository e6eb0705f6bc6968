"""Chat formatting with any template: turns are located by rendering prefixes, losses fall on assistants' texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.llm.ordering import group_key, numbered
from loomwork.session import materialise

#: (role, text) of one turn; a template turns a list of them into one string and nothing else is known of it.
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Rows of Arrow batches are cut into outputs of about so many characters.
BATCH_CHARS = 8_000_000
#: Probes that stand for a text: a template's marks around a text are what two of them have in common.
PROBES = ("a", "b")


@dataclass(frozen=True)
class MarkedTurns:
    """`### Role: text</turn>` and a newline for each turn, with the control strings escaped in roles and texts."""

    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>\n"

    def escape(self, text: str) -> str:
        """A backslash before each backslash, `#`, `:` and `<`, so that no mark and no half of one occurs in the result."""
        return re.sub(r"[\\#:<]", lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"{self.opening}{self.escape(role)}{self.middle}{self.escape(text)}{self.closing}" for role, text in turns)

    def parse(self, rendered: str) -> list[Turn]:
        """The turns that a rendered string holds, unescaped; ValueError if it isn't one."""
        part = r"([^\\#:<]*+(?:\\.[^\\#:<]*+)*+)"
        one = re.compile(re.escape(self.opening) + part + re.escape(self.middle) + part + re.escape(self.closing), re.S)
        turns, at = [], 0
        while at < len(rendered):
            if not (m := one.match(rendered, at)):
                raise ValueError(f"no turn at {at}")
            turns.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return turns


@dataclass
class Rendered:
    """A part of a conversation as rendered. rewritten: the first turn (from 0) whose addition changed what stood before."""

    text: str
    turns: list[tuple[int, int]]
    losses: list[tuple[int, int]]
    rewritten: int | None = None


def _common(a: str, b: str, start: int) -> int:
    """Length of what a and b have in common, known to be at least start."""
    end = min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    return start


def text_place(template: Template, before: list[Turn], role: str, piece: int, whole: str, ends: str = "") -> tuple[int, int] | None:
    """Where the last turn's text stands in `whole`, in which that turn starts at `piece`.

    The turn is rendered with two texts that differ in all their characters; what both have in common in front and
    behind are the template's marks. None if `whole` doesn't bear these marks, as with a template that changes texts.
    """
    one, two = (template([*before, (role, probe)]) for probe in PROBES)
    front = _common(one, two, min(piece, len(one), len(two)))
    back = _common(one[front:][::-1], two[front:][::-1], 0)
    if one[:front] != whole[:front] or (back and one[-back:] != whole[-back:]) or front + back > len(whole):
        return None
    return front, len(whole) - back


def render(template: Template, turns: list[Turn], context: int = 0, lossy: Iterable[str] = ("assistant",)) -> Rendered:
    """Renders successive prefixes of turns and compares each output with the one before.

    Where an output starts with the one before, what it adds is the turn's span. Where it doesn't, the template
    rewrites history: nothing is located then and `rewritten` tells the turn, as where its marks depend on a text. A
    loss is the text as the template writes it. The first `context` turns only stand in front: the result is what the
    others add to them.
    """
    lossy, marks, losses, last, rewritten = set(lossy), [], [], template(turns[:context]) if context else "", None
    base = len(last)
    for k in range(context, len(turns)):
        output = template(turns[: k + 1])
        if not output.startswith(last):
            rewritten = k - context
            break
        marks.append((len(last) - base, len(output) - base))
        if turns[k][0] in lossy:
            place = text_place(template, turns[:k], turns[k][0], len(last), output)
            if place is None:
                rewritten = k - context
                break
            losses.append((place[0] - base, place[1] - base))
        last = output
    if rewritten is not None:
        return Rendered(template(turns)[base:], [], [], rewritten)
    return Rendered(last[base:], marks, losses)


SPANS = "array<struct<start:long,end:long>>"
FORMATTED = f"part long, parts long, formatted string, turns {SPANS}, losses {SPANS}, rewritten long"


def format_chats(
    turns: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    lossy: Iterable[str] = ("assistant",),
    part_turns: int = 256,
    context_turns: int = 8,
) -> DataFrame:
    """(conv_col, part, parts, formatted, turns, losses, rewritten): conversations as the template renders them.

    `turns` are the spans of the turns in `formatted` and `losses` those of the texts of the roles in `lossy`, as code
    points with exclusive ends; they are found by rendering, so the template can be any function of a list of turns.
    `rewritten` is the turn at which a template was found to change what stood before (spans are then empty), else null.

    A conversation of up to part_turns rows is one part. Renderings of prefixes cost the square of the number of turns,
    so a longer one, be it a third of all rows, is cut into parts of so many turns, which are rendered behind the
    last context_turns turns before them; its formatted text is that of its parts in order. For this a template may look
    back context_turns turns at most. Turns of long conversations alone are numbered first.

    Cases: turns stand in the order of turn, then role, then text, nulls first; repeated rows are turns of their own;
    a null role or text is empty; rows without an id are one conversation; an empty table gives no rows. Other columns
    are left out, whatever their names.
    """
    template, lossy = template or MarkedTurns(), tuple(lossy)
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        group_key(F.col(f"`{conv_col}`")).alias("_g"),
        F.col(f"`{conv_col}`").alias("_conv"),
        F.col(f"`{turn_col}`").alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )
    long = materialise(rows.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > part_turns), "long-chats")
    one = rows.withColumns({"_part": F.lit(0).cast("long"), "_parts": F.lit(1).cast("long"), "_i": F.lit(0).cast("long"), "_own": F.lit(True)})
    if not long.isEmpty():
        one = one.join(long, "_g", "left_anti")
        named = numbered(rows.join(long.select("_g"), "_g", "left_semi"), ["_turn", "_role", "_text"], "long-turns").join(long, "_g")
        own, last = F.expr(f"_i div {part_turns}"), F.expr(f"(_n - 1) div {part_turns}")
        shown = F.when((F.col("_i") % part_turns >= part_turns - context_turns) & (own < last), F.array(own, own + 1)).otherwise(F.array(own))
        many = named.withColumn("_part", F.explode(shown)).withColumns({"_parts": last + 1, "_own": F.col("_part") == own})
        one = one.unionByName(many.select(*one.columns))
    order = ["_g", "_part", "_i", "_turn", "_role", "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("_conv", "_part", "_parts", "_role", "_text", "_own")], strict=True))
        held, size = [], 0
        for (conv, part, parts), group in groupby(flat, key=lambda row: row[:3]):
            said = list(group)
            context = sum(not row[5] for row in said)
            got = render(template, [(row[3], row[4]) for row in said], context, lossy)
            shift = part * part_turns
            held.append((conv, part, parts, got.text, got.turns, got.losses, None if got.rewritten is None else got.rewritten + shift))
            size += len(got.text)
            if size > BATCH_CHARS:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv", to_arrow_type(turns.schema[conv_col].dataType)), ("part", pa.int64()), ("parts", pa.int64()), ("formatted", pa.string()), ("turns", spans), ("losses", spans), ("rewritten", pa.int64())])
    dealt = one.repartition("_g", "_part").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv {kind}, {FORMATTED}").withColumnRenamed("conv", conv_col)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    for k in (4, 5):
        columns[k] = [[{"start": s, "end": e} for s, e in spans] for spans in columns[k]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class Digest:
    """What a formatted conversation says, read back part by part; memory doesn't grow with the parts."""

    def __init__(self, template: MarkedTurns):
        self.template, self.n_turns, self.loss_chars, self.formatted_chars = template, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, losses: list[dict]) -> None:
        for role, text in self.template.parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in losses:
            text = self.template.unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)


def read_back(formatted: DataFrame, template: MarkedTurns | None = None, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations, from what format_chats made.

    Turns are parsed from `formatted`, losses cut out by their spans; both are unescaped. One-part conversations are read
    where they lie; parts of the others come together in order and stream through their digest one by one.
    """
    template = template or MarkedTurns()
    kind = formatted.schema[conv_col].dataType.simpleString()
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("_conv", "formatted", "losses")], strict=True)

        held = []
        for conv, parts in groupby(said(), key=lambda row: row[0]):
            digest = Digest(template)
            for _, text, losses in parts:
                digest.add(text, losses)
            held.append((conv, digest.n_turns, digest.turns.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.formatted_chars))
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    types = [to_arrow_type(formatted.schema[conv_col].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows = formatted.select(F.col(conv_col).alias("_conv"), "part", "parts", "formatted", "losses")
    schema = f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    single = rows.where("parts = 1").mapInArrow(run, schema)
    several = rows.where("parts > 1").repartition("_conv").sortWithinPartitions("_conv", "part").mapInArrow(run, schema)
    return single.unionByName(several)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that imitates control strings, read back from the formatted table."""
    said = r"\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(materialise(format_chats(turns.unionByName(own)), "chats"))


#: Fixed values of the contract: the planted conversation; the escapes and marks are those of MarkedTurns.
ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(regexp_replace(role || text, '([\\#:<])', 'xx', 'g')) + 14)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
