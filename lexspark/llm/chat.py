"""Conversations folded from event logs, and rendered with marked turns and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of events: a new message, text streamed onto a message, a message's new text, and a message
#: that starts afresh while all after it go.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
#: Characters of text in an event of a log made from finished rows.
PIECE = 2000


def escape(text: str) -> str:
    """Text without an unescaped < or >, so that no mark of the template can occur in it."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, mask): each turn as <turn ROLE>, its text, </turn> and a line end; mask holds the first
    and last + 1 code points of assistant texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<turn {escape(role)}>\n", escape(text), "\n</turn>\n"
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), mask


HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        end = formatted.index("\n</turn>\n", head.end())  # < in a text is escaped
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len("\n</turn>\n")
    return turns


def fold(state: list[list], kind: str, target: int | None, role: str | None, text: str | None) -> None:
    """Apply an event to the messages so far, [role, parts]. target: a message's number, null for the last.
    Events on a message that is not there are ignored."""
    if kind == MESSAGE:
        state.append([role or "", [text or ""]])
        return
    at = len(state) - 1 if target is None or pd.isna(target) else int(target)
    if not 0 <= at < len(state):
        return
    if kind == DELTA:
        state[at][1].append(text or "")
    elif kind == EDIT:
        state[at][1] = [text or ""]
    elif kind == REGENERATE:
        del state[at + 1 :]
        state[at] = [role or state[at][0], [text or ""]]


def fold_conversations(events: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id string, turns, formatted, mask) of each conversation of an event log.

    events: conv_id, kind, target, role, text and the columns of order. Events are dealt by conv_id and
    sorted within partitions, then folded as they stream by, so a task holds one conversation's messages
    at a time, however many events made them. A null conv_id is a conversation of its own, null roles
    and texts are empty, unknown kinds are ignored, ties of order go by kind, target, role and text, an
    empty log gives no rows; other columns are dropped. One conversation, and all rows of a null conv_id, are
    folded in one task, since each event builds on those before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, rows = None, [], []

        def close() -> None:
            turns = [(role, "".join(parts)) for role, parts in state]
            formatted, mask = render(turns)
            rows.append((current[0], turns, formatted, mask))

        for batch in batches:
            for conv, kind, target, role, text in zip(*[batch[c] for c in ("conv_id", "kind", "target", "role", "text")], strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current, state = (conv,), []
                fold(state, kind, target, role, text)
            if rows:
                yield pd.DataFrame(rows, columns=["conv_id", "turns", "formatted", "mask"])
                rows = []
        if current is not None:
            close()
            yield pd.DataFrame(rows, columns=["conv_id", "turns", "formatted", "mask"])

    dealt = events.withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", *order, "kind", "target", "role", "text")
    schema = "conv_id string, turns array<struct<role:string,text:string>>, formatted string, mask array<struct<start:long,stop:long>>"
    return dealt.select("conv_id", "kind", F.col("target").cast("int").alias("target"), "role", "text").mapInPandas(run, schema)


def log_of(conversations: DataFrame) -> tuple[DataFrame, list[str]]:
    """(events, order): a log whose fold gives the rows of conversations, in the order of turn.

    Assistant turns begin with a draft, are regenerated and streamed in pieces of PIECE characters;
    other turns begin as a draft and are edited. Rows of the same turn are ordered by role and the hash of
    their text; rows equal in all of these are interchangeable.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    )
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(n / PIECE).cast("int")),
        lambda k: event(DELTA, F.substring("text", k * PIECE + 1, F.lit(PIECE))),
    )
    draft = F.substring("text", F.lit(1), F.lit(20))
    streamed = F.concat(F.array(event(MESSAGE, draft), event(DELTA, F.lit(" ...")), event(REGENERATE, F.lit(""))), pieces)
    edited = F.array(event(MESSAGE, draft), event(EDIT, F.col("text")))
    events = rows.select(
        "conv_id", "turn", "role", "tie", "row", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("step", "e")
    ).select("conv_id", "turn", "role", "tie", "row", "step", "e.kind", "e.text", F.lit(None).cast("int").alias("target"))
    return events, ["turn", "role", "tie", "row", "step"]


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for conv, formatted, mask in zip(batch["conv_id"], batch["formatted"], batch["mask"], strict=True):
            turns = parse(formatted)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(unescape(formatted[m["start"] : m["stop"]]) for m in mask)
            rows.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_digests(folded: DataFrame) -> DataFrame:
    """What is read back from formatted and mask of each conversation."""
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = folded.select("conv_id", "formatted", "mask").mapInPandas(_digests, schema)
    return rows.withColumn("conv_id", F.col("conv_id").cast("long"))
