"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template gives each role its opening and closing marks and says whether its text is learned (the loss flag). The
machine reads a conversation's turns in order, moves from state to state by role, and emits segments: marks without
loss, texts with their role's flag. A role that the current state does not allow is still emitted but makes the
conversation invalid, so no turn is lost. Inside a text the escape character and the first character of every
control string are escaped, so that no control string can occur in it; unescaping is exact.

Turns are ordered by turn (null first), then role and text, which defines ties; repeated rows are turns like others.
Null text is empty, a null or unknown role is formatted with the fallback marks and is never learned. Extra columns
are ignored. A conversation's turns stream through one task in order and are never held together as rows; the output
is emitted as one row per segment (segments) or read back turn by turn (read_back).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

START = "start"


@dataclass(frozen=True)
class Template:
    """marks: role -> (opening, closing, learned); moves: state -> {role: next state}; final: states that may end."""

    marks: dict[str, tuple[str, str, bool]]
    moves: dict[str, dict[str, str]]
    final: frozenset[str]
    fallback: tuple[str, str] = ("<<ROLE {}>>", "<</ROLE>>")
    begin: str = "<s>"
    end: str = "</s>"
    escape: str = "\\"
    first: str = field(default="", init=False)

    def __post_init__(self) -> None:
        strings = [self.begin, self.end, *self.fallback, *(m for a, b, _ in self.marks.values() for m in (a, b))]
        object.__setattr__(self, "first", "".join(sorted({s[0] for s in strings if s} | {self.escape})))

    def escaped(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.first)}])", lambda m: self.escape + m[1], text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)

    def opening(self, role: str | None) -> str:
        if role in self.marks:
            return self.marks[role][0]
        return self.fallback[0].format(self.escaped(role or "").replace(">", self.escape + ">"))

    def closing(self, role: str | None) -> str:
        return self.marks[role][1] if role in self.marks else self.fallback[1]

    def learned(self, role: str | None) -> bool:
        return role in self.marks and self.marks[role][2]


CHAT = Template(
    marks={
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<<OUT>>", "<</OUT>>", True),
    },
    moves={
        START: {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    final=frozenset({"assistant"}),
)


class Machine:
    """Emits (text, loss, kind) segments turn by turn and keeps track of validity."""

    def __init__(self, template: Template):
        self.template, self.state, self.valid = template, START, True

    def turn(self, role: str | None, text: str | None) -> Iterator[tuple[str, bool, str]]:
        t = self.template
        to = t.moves.get(self.state, {}).get(role or "")
        self.valid, self.state = self.valid and to is not None, to or role or ""
        yield t.opening(role), False, "open"
        yield t.escaped(text or ""), t.learned(role), "text"
        yield t.closing(role), False, "close"

    def ends_well(self) -> bool:
        return self.valid and self.state in self.template.final


class Reader:
    """Reads formatted text back, turn by turn; it knows only the template's strings."""

    def __init__(self, template: Template):
        self.template = t = template
        opens = "|".join(f"(?P<r{i}>{re.escape(a)})" for i, (a, _, _) in enumerate(t.marks.values()))
        a, b = t.fallback[0].split("{}")
        esc, body = re.escape(t.escape), rf"(?:{re.escape(t.escape)}.|[^{re.escape(t.first)}])*"
        self.roles = list(t.marks)
        self.open = re.compile(rf"(?:{opens}|{re.escape(a)}(?P<other>(?:{esc}.|[^{re.escape(t.first)}>])*){re.escape(b)})", re.S)
        self.body = re.compile(body, re.S)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        t, at = self.template, len(self.template.begin)
        if not formatted.startswith(t.begin) or not formatted.endswith(t.end):
            raise ValueError("not a formatted conversation")
        while at < len(formatted) - len(t.end):
            role, text, at = self.one(formatted, at)
            yield role, text

    def one(self, formatted: str, at: int) -> tuple[str, str, int]:
        m = self.open.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = self.template.unescaped(m["other"]) if m["other"] is not None else next(r for i, r in enumerate(self.roles) if m[f"r{i}"])
        body = self.body.match(formatted, m.end())
        close = self.template.closing(role)
        if not formatted.startswith(close, body.end()):
            raise ValueError(f"turn at {at} is not closed")
        return role, self.template.unescaped(body[0]), body.end() + len(close)


class Playback:
    """Reads one conversation's formatted text back as it arrives: feed() takes what was written, wherever it is cut,
    with the loss spans that end in it, and yields its whole turns; learned() the text under the loss mask, unescaped.

    Spans are offsets into the whole output, so a span that is off yields other text. Only what is not yet read is held.
    """

    def __init__(self, reader: Reader):
        self.reader, self.held, self.base, self.size, self.began = reader, "", 0, 0, False

    def feed(self, written: str) -> Iterator[tuple[str, str]]:
        self.held += written
        self.size += len(written)
        at, t = self.base, self.reader.template
        if not self.began:
            if not self.held.startswith(t.begin):
                raise ValueError("not a formatted conversation")
            self.began, at = True, len(t.begin)
        while len(self.held) > at - self.base and self.held[at - self.base:] != t.end:
            try:
                role, text, end = self.reader.one(self.held, at - self.base)
            except ValueError:
                break  # the rest of the turn has not arrived
            yield role, text
            at = self.base + end
        self.read = at

    def learned(self, spans: Iterable[tuple[int, int]]) -> Iterator[str]:
        """Text under the mask; to be asked for before drop()."""
        for a, b in spans:
            yield self.reader.template.unescaped(self.held[a - self.base:b - self.base])

    def drop(self) -> None:
        """Forget what has been read."""
        self.held, self.base = self.held[self.read - self.base:], self.read

    def close(self) -> None:
        if self.held != self.reader.template.end:
            raise ValueError("the conversation did not read back to its end")


def format_conversation(turns: Iterable[tuple[str | None, str | None]], template: Template = CHAT) -> tuple[str, list[tuple[int, int]], bool]:
    """Whole text, loss spans (code points, end exclusive) and validity of one conversation held in memory."""
    m, out, spans, at = Machine(template), [template.begin], [], len(template.begin)
    for role, text in turns:
        for piece, loss, _ in m.turn(role, text):
            if loss:
                spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)
    return "".join([*out, template.end]), spans, m.ends_well()


def _ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    slim = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "_role", "_text")


def segments(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """One row per segment: conv_id, segment (number in order), kind, text, loss, valid (so far, moves included)."""
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col)
    schema = rows.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit("").alias("kind"), F.lit("").alias("text"), F.lit(True).alias("loss"), F.lit(True).alias("valid")).schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, machine, n, began, id_type = None, Machine(template), 0, False, None
        for batch in batches:
            out: list[tuple] = []
            id_type = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_role", "_text")), strict=True):
                if not began or conv != last:
                    if began:
                        out.append((last, n, "end", template.end, False, machine.ends_well()))
                    last, machine, n, began = conv, Machine(template), 1, True
                    out.append((conv, 0, "begin", template.begin, False, True))
                for piece, loss, kind in machine.turn(role, text):
                    out.append((conv, n, kind, piece, loss, machine.valid))
                    n += 1
            yield _batch(out, id_type)
        if began:
            yield _batch([(last, n, "end", template.end, False, machine.ends_well())], id_type)

    def _batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["conv_id", "segment", "kind", "text", "loss", "valid"])

    return rows.mapInArrow(emit, schema)


def digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """Per conversation, read back from the formatted output and its loss mask: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars and valid. The output streams from the writer to the reader, so memory holds one turn,
    however long the conversation."""
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col)
    schema = rows.select("conv_id", F.lit(0).cast("long").alias("n_turns"), F.lit("").alias("turns_sha256"), F.lit(0).cast("long").alias("loss_chars"), F.lit("").alias("loss_sha256"), F.lit(0).cast("long").alias("formatted_chars"), F.lit(True).alias("valid")).schema
    names = schema.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done, conv, began, id_type = Reader(template), [], None, False, None
        machine = turns = loss = back = None
        n = chars = size = 0

        def listen(written: str, spans: list[tuple[int, int]]) -> None:
            nonlocal n, chars
            for role, text in back.feed(written):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for text in back.learned(spans):
                chars += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
            back.drop()

        def close() -> None:
            listen(template.end, [])
            back.close()
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), back.size, machine.ends_well()))

        def flush() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            cols = list(zip(*done, strict=True)) if done else [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            id_type = batch.column("conv_id").type
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_role", "_text")), strict=True):
                if not began or key != conv:
                    if began:
                        close()
                    conv, began, machine, back = key, True, Machine(template), Playback(reader)
                    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, len(template.begin)
                    listen(template.begin, [])
                written, spans = [], []
                for piece, flagged, _ in machine.turn(role, text):
                    if flagged:
                        spans.append((size, size + len(piece)))
                    written.append(piece)
                    size += len(piece)
                listen("".join(written), spans)
            yield flush()
        if began:
            close()
            yield flush()

    return rows.mapInArrow(read, schema)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(table.unionByName(extra)).drop("valid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_chat_format": op8_chat_format}
ORACLE_SQL = {
    "op8_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        m AS (
            SELECT *, CASE role WHEN 'system' THEN length('<<SYS>><</SYS>>') WHEN 'user' THEN length('[INST][/INST]')
                      WHEN 'assistant' THEN length('<<OUT>><</OUT>>') END AS marks
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(length('<s></s>') + sum(marks + length(text) + length(text) - length(translate(text, '\[<', ''))) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
}
