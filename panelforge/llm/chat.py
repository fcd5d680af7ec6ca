r"""Chat formatting with a grammar round trip.

A turn is rendered as

    ### <role>:
    <text>
    </turn>

Rendered turns are reparsed with a deterministic parser and compared with the
source. Where they differ, the text holds something that the grammar takes for
its own control strings ("### " and "</turn>"), and every such place is escaped
with one more backslash; this is repeated until the round trip is exact. Parsing
takes one backslash off every escaped control string, so escaping is reversible
at any depth (a source text may hold escaped control strings itself).

Edge cases: a null text is an empty text, a null role an empty role; rows
without a conversation id form one conversation of their own (id null); turns
with equal numbers are ordered by role, then text, and repeated rows are
repeated turns; an empty table gives an empty result. Only the four columns of
a conversation are read. A conversation is one value of the output, so one task
builds it turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

OPEN, CLOSE = "### ", "</turn>"
CONTROL = re.compile(r"(\\*)(### |</turn>)")
LEARNED_ROLE = "assistant"

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m.group(0)[1:] if m.group(1) else m.group(0), text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m.group(1), m.group(1)), role)


def render(role: str, body: str) -> str:
    return f"{OPEN}{escape_role(role)}:\n{body}\n{CLOSE}\n"


def parse(formatted: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end delimit its escaped text. Stops where the grammar is broken."""
    while formatted.startswith(OPEN, at):
        line = formatted.find("\n", at)
        if line < 0 or formatted[line - 1] != ":":
            return
        start = line + 1
        end = next((m.start() for m in CONTROL.finditer(formatted, start) if not m.group(1)), -1)
        if end <= start or formatted[end - 1] != "\n" or not formatted.startswith(CLOSE + "\n", end):
            return
        yield unescape_role(formatted[at + len(OPEN) : line - 1]), unescape(formatted[start : end - 1]), start, end - 1
        at = end + len(CLOSE) + 1


def format_turn(role: str, text: str) -> tuple[str, str]:
    """The rendered turn and its (escaped) body, once the round trip is exact."""
    body = text
    for _ in range(3):
        segment = render(role, body)
        turns = list(parse(segment))
        if len(turns) == 1 and turns[0][:2] == (role, text) and turns[0][3] + len(CLOSE) + 2 == len(segment):
            return segment, body
        body = escape(text)
    raise ValueError("a turn does not survive its round trip")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): the loss spans are the assistant texts, in code points of formatted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        current, begun, parts, spans, size = None, False, [], [], 0

        def whole():
            return {"conv_id": current, "n_turns": len(parts), "formatted": "".join(parts), "loss_spans": spans}

        done: list[dict] = []
        held = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and conv != current:
                    done.append(whole())
                    held += size
                    parts, spans, size = [], [], 0
                current, begun = conv, True
                segment, body = format_turn(role, text)
                if role == LEARNED_ROLE:
                    start = size + len(segment) - len(body) - len(CLOSE) - 2
                    spans.append({"start": start, "end": start + len(body)})
                parts.append(segment)
                size += len(segment)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done, held = [], 0
        if begun:
            done.append(whole())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back: turns by the parser, learned text by the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, spans in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns, learned, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, body, _, _ in parse(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for span in spans:
                    body = unescape(text[span["start"] : span["end"]])
                    learned.update(body.encode())
                    chars += len(body)
                for k, v in zip(out, (conv, n, turns.hexdigest(), chars, learned.hexdigest(), len(text)), strict=True):
                    out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds: both turns hold an escaped control string and a closing one.
ADDED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return digests(format_conversations(conversations))
