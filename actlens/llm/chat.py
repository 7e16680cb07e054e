"""Chat formatting from event logs.

``event_log`` turns the rows of conversations into the log that a chat
service would write: a message starts, its text streams in as deltas, an
assistant's first draft is regenerated, and a user's message is corrected by
edits.  ``messages`` reconstructs: events are dealt by conversation and
message, sorted by sequence and folded into final messages, so a
conversation that holds a third of the log is many small folds.  ``formatted``
renders each message as one part of its conversation, with the span of its
text that counts for the loss; ``read_back`` parses the parts of each
conversation in order, one after another.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts a backslash is doubled, ``<|`` becomes ``<\\|`` and a role's line break
``\\n``, so no control string of a text survives and reading undoes it.

Defined results: a null text or role is empty; rows of a conversation with
equal turn follow in the order of role and text, a null turn comes first;
rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.llm.common import stored, table

DELTA = 64

# The template's control strings and the role that counts for the loss.
START, STOP = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: The conversation added by the query: both rows say the control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"

_PART = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(STOP) + r"\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def event_log(conversations: DataFrame) -> DataFrame:
    """Events (conv_id, turn, copy, seq, kind, role, at, cut, text) of conversations (conv_id, turn, role, text).

    kinds: start (role), delta (append text), edit (replace ``cut`` characters at ``at`` by text),
    regenerate (begin the text anew)."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    size = F.length("text")
    event = lambda kind, text="", at=-1, cut=0: F.struct(
        F.lit(kind).alias("kind"), F.col("role"), (at if not isinstance(at, int) else F.lit(at)).alias("at"),
        F.lit(cut).alias("cut"), (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    deltas = F.transform(F.sequence(F.lit(0), F.floor((size + DELTA - 1) / DELTA).cast("int")),
                         lambda k: event("delta", F.substring(F.col("text"), k * DELTA + 1, F.lit(DELTA))))
    draft = F.array(event("delta", F.reverse("text")), event("regenerate"))
    # a user's text first misses its middle character, which an edit puts in
    half = F.floor(size / 2).cast("int")
    typed = F.array(event("delta", F.concat(F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 2, size))),
                    event("edit", F.substring(F.col("text"), half + 1, F.lit(1)), half))
    body = F.when(F.col("role") == LOSS_ROLE, F.concat(draft, deltas)).when(F.col("role") == "user", typed).otherwise(deltas)
    events = F.concat(F.array(event("start")), body)
    return rows.select("conv_id", "turn", "copy", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "copy", "seq", "e.*")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, role, text = None, "", ""
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        names = ["conv_id", "turn", "copy", "role", "text"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    parts: list[str] = []
    for batch in batches:
        for conv_id, turn, copy, _, kind, event_role, at, cut, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv_id, turn, copy):
                if key is not None:
                    out.append((*key, role, "".join(parts)))
                key, role, parts = (conv_id, turn, copy), "", []
            if kind == "start":
                role = event_role
            elif kind == "delta":
                parts.append(piece)
            elif kind == "regenerate":
                parts = []
            elif kind == "edit":
                text = "".join(parts)
                parts = [text[:at] + piece + text[at + cut:]]
        yield rows()
        out = []
    if key is not None:
        out.append((*key, role, "".join(parts)))
        yield rows()


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text)."""
    key = ["conv_id", "turn", "copy"]
    return events.repartition(*key).sortWithinPartitions(*key, "seq").mapInArrow(
        _fold, "conv_id long, turn long, copy int, role string, text string")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, begins, ends = [], [], []
        for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            head, body = START + escape_role(role) + "\n", escape(text)
            parts.append(head + body + STOP + "\n")
            begins.append(len(head) if role == LOSS_ROLE else None)
            ends.append(len(head) + len(body) if role == LOSS_ROLE else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(parts, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
            names=["conv_id", "turn", "copy", "part", "loss_from", "loss_to"])


def formatted(final: DataFrame) -> DataFrame:
    """Parts of the formatted conversations (conv_id, turn, copy, part) and the loss span of each; a conversation
    is its parts in the order of turn and copy."""
    return final.mapInArrow(
        _render, "conv_id long, turn long, copy int, part string, loss_from int, loss_to int")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, done = None, None, []

    def row() -> tuple:
        return (key[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    def rows() -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        for conv_id, part, begin, end in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
            if key != (conv_id,):
                if key is not None:
                    done.append(row())
                key = (conv_id,)
                state = {"n": 0, "chars": 0, "loss_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            match = _PART.fullmatch(part)
            if match is None:
                raise ValueError(f"conversation {conv_id} has a part that is no turn")
            state["n"] += 1
            state["chars"] += len(part)
            state["turns"].update(f"{unescape(match[1])}\n{unescape(match[2])}\n".encode())
            if begin is not None:
                learned = unescape(part[begin:end])
                state["loss_chars"] += len(learned)
                state["loss"].update(learned.encode())
        yield rows()
        done = []
    if key is not None:
        done.append(row())
        yield rows()


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from its parts: n_turns, digest of its turns, length and digest of the text under the
    loss mask, and the length of the formatted conversation.  Turns are digested as they come, none is kept."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "copy").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, logged, reconstructed, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(PROBE).alias("text"))
    log = stored(event_log(rows.unionByName(probe)), "chat-events")
    return read_back(stored(formatted(messages(log)), "chat-formatted"))


ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, '{LOSS_ROLE}', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(STOP) + 2}
    + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
