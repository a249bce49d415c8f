"""Chat formatting from event logs.

A log row says what happened to one turn of a conversation: ``message`` opens it with a role and
text, ``delta`` appends streamed text, ``edit`` replaces the text, ``regenerate`` throws it away
for a new attempt. Logs are partitioned by conversation and sorted by turn and sequence; one pass
folds each turn's events into its final message and renders it. A task holds one message at a
time, however long a conversation is; a conversation stays in one task, since its turns are in
order.

The template: ``[INST] user [/INST]``, `` assistant </s>`` and ``<<SYS "role">>`` for all other
roles. Wherever a text holds one of its control strings, a backslash is put in after its opening
bracket (after those already there), so no text can end a turn, and taking one away restores it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch
from loanweave.storage import written

# The control strings' opening brackets and what follows them.
_OPENING = r"(<<(?={0}/?SYS)|<(?={0}/?s>)|\[(?={0}/?INST\]))"
_ESCAPE = re.compile(_OPENING.format(r"\\*"))
_UNESCAPE = re.compile(_OPENING.format(r"\\+") + r"\\")
PIECE = 256  # characters in a streamed delta of a derived log
EVENTS = "conv_id long, turn long, tie string, line long, seq int, event string, role string, text string"
SEGMENTS = "conv_id long, position long, role string, segment string, loss_start long, loss_length long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
ROWS_PER_BATCH = 2000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """(a turn's segment, where its loss begins, how long that is)."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body} </s>", 1, len(body)
    return f"<<SYS {json.dumps(role)}>>\n{body}\n<</SYS>>\n", 0, 0


def parse(segment: str) -> tuple[str | None, str]:
    """The (role, text) that ``render`` was given."""
    if segment.startswith("[INST] "):
        return "user", unescape(segment[len("[INST] ") : -len(" [/INST]")])
    if segment.startswith(" "):
        return "assistant", unescape(segment[1 : -len(" </s>")])
    head, _, rest = segment.partition(">>\n")
    return json.loads(head[len("<<SYS ") :]), unescape(rest[: -len("\n<</SYS>>\n")])


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log behind a table of final turns (conv_id, turn, role, text), as a server that
    streams would have written it: an assistant's turn opens empty, streams a first attempt that
    is regenerated, then streams its text; others are drafted and then edited to their text."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        text.alias("text"), F.md5(F.concat_ws("\n", F.coalesce("role", F.lit("")), text)).alias("tie"),
    ).withColumn("line", F.monotonically_increasing_id())
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")),
        lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)),
    )

    def event(kind: str, what) -> F.Column:
        return F.struct(F.lit(kind).alias("event"), what.alias("text"))

    streamed = F.concat(
        F.array(event("message", F.lit("")), event("delta", F.substring("text", 1, PIECE)),
                event("regenerate", F.lit(""))),
        F.when(F.length("text") > 0, F.transform(pieces, lambda p: event("delta", p)))
        .otherwise(F.array().cast("array<struct<event:string,text:string>>")),
    )
    edited = F.array(event("message", F.substring("text", 1, PIECE)), event("edit", F.col("text")))
    log = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    return rows.select("conv_id", "turn", "tie", "line", "role", F.posexplode(log).alias("seq", "e")).select(
        "conv_id", "turn", "tie", "line", "seq", "e.event", "role", "e.text"
    )


def format_chat(log: DataFrame) -> DataFrame:
    """Rendered turns: conv_id, position (from 0), role, segment, loss_start, loss_length (the
    part of the segment that is trained on: an assistant's text). A conversation's output is its
    segments in order.

    Events are in order of turn, tie, line and seq. Each ``message`` opens a turn of its own, even
    under a number seen before, so repeated rows are repeated turns; any other event without an
    open turn opens one. Null texts are empty, null turns come first, null conversations form one,
    unknown events are read as deltas. Other columns are not read; no events give no rows.
    """
    schema = arrow_schema(SEGMENTS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, line, role, text, position, out = nothing, None, None, [], 0, []

        def close() -> None:
            segment, start, length = render(role, "".join(text))
            out.append((conv, position, role, segment, start, length))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "tie", "line", "event", "role", "text"))
            for conv_, turn_, tie_, line_, event, role_, part in zip(*columns):
                part, key = part or "", (turn_, tie_, line_)
                if conv is nothing or conv_ != conv or key != line or event == "message":
                    if conv is not nothing:
                        close()
                        position = position + 1 if conv_ == conv else 0
                    conv, line, role, text = conv_, key, role_, [part]
                elif event == "edit":
                    text = [part]
                elif event == "regenerate":
                    text = []
                else:
                    text.append(part)
            if len(out) >= ROWS_PER_BATCH:
                yield record_batch(list(zip(*out)), schema)
                out.clear()
        if conv is not nothing:
            close()
        if out:
            yield record_batch(list(zip(*out)), schema)

    ordered = for_tasks(log).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "line", "seq")
    return ordered.mapInArrow(fold, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """What a reader of the output finds in each conversation: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Hashes are fed turn by turn."""
    schema = arrow_schema(DIGESTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, out = nothing, []
        turns = lost = None
        count = lost_chars = chars = 0

        def close() -> None:
            out.append((conv, count, turns.hexdigest(), lost_chars, lost.hexdigest(), chars))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length"))
            for conv_, segment, start, length in zip(*columns):
                if conv is nothing or conv_ != conv:
                    if conv is not nothing:
                        close()
                    conv, turns, lost = conv_, hashlib.sha256(), hashlib.sha256()
                    count = lost_chars = chars = 0
                role, text = parse(segment)
                turns.update(f"{role or ''}\n{text}\n".encode())
                loss = unescape(segment[start : start + length])
                lost.update(loss.encode())
                count, chars, lost_chars = count + 1, chars + len(segment), lost_chars + len(loss)
            if len(out) >= ROWS_PER_BATCH:
                yield record_batch(list(zip(*out)), schema)
                out.clear()
        if conv is not nothing:
            close()
        if out:
            yield record_batch(list(zip(*out)), schema)

    ordered = for_tasks(segments).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(read, DIGESTS)


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Format a table of turns through its event log, store the output, and read it back."""
    return digests(written(format_chat(log_of(conversations)), "chat-segments"))
