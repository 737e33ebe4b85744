"""Chat formatting from event logs: fold deltas, edits and regenerations into messages, then render and read back.

The log of a conversation is sorted by sequence and folded message by message: `start` opens one with a role, `delta`
appends, `edit` replaces the text so far, `regenerate` discards it. A fold groups by conversation and message, so a
conversation that holds a third of all events spreads out; only whole turns, in order, reach the task that reads a
conversation, as a stream with a constant state.

Nulls: a null text is empty, a null role is the empty role, null conversation ids are one conversation. Repeated events
with equal sequence count once each, in order of kind and text. Messages without text still are turns. An empty log gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names that the template shows for the usual roles. Any other role is shown after an equals sign.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def fold_events(events: DataFrame, *, conv: str = "conv_id", msg: str = "msg", seq: str = "seq") -> DataFrame:
    """conv_id, msg, first_seq, role, text: the final state of every message of a log of (conv, msg, seq, kind, role, text)."""
    own = events.select(F.col(conv).alias("conv_id"), F.col(msg).alias("msg"), F.struct(F.col(seq).alias("seq"), "kind", "text", "role").alias("e"))
    log = own.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("log"))
    # the last event that empties or replaces the text; what follows is appended
    last = F.expr("coalesce(array_max(filter(transform(log, (e, i) -> IF(e.kind = 'delta', -1, i)), i -> i >= 0)), 0)")
    kept = F.expr("slice(log, from + 1, size(log))")
    text = F.array_join(F.transform(kept, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    role = F.coalesce(F.expr("get(filter(log, e -> e.role is not null), 0).role"), F.lit(""))
    return log.withColumn("from", last).select("conv_id", "msg", F.col("log")[0]["seq"].alias("first_seq"), role.alias("role"), text.alias("text"))


def _escaped(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"([{chars}])", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, first_seq, segment, loss_start, loss_length: each turn as text; a conversation is its segments in order.

    ``### Name: text</turn>`` and a line feed. In texts every backslash, # and < gets a backslash before it, in names a
    colon too, so no control string can occur inside. The loss covers the text of assistant turns.
    """
    name = F.lit(None).cast("string")
    for role, shown in NAMES.items():
        name = F.when(F.col("role") == role, shown).otherwise(name)
    name = F.coalesce(name, F.concat(F.lit("="), _escaped(F.col("role"), r"\\\\#<:")))
    head, body = F.concat(F.lit("### "), name, F.lit(": ")), _escaped(F.coalesce("text", F.lit("")), r"\\\\#<")
    loss = F.when(F.col("role") == "assistant", F.length(body)).otherwise(0)
    return messages.select("conv_id", "first_seq", F.concat(head, body, F.lit("</turn>\n")).alias("segment"), F.length(head).alias("loss_start"), loss.alias("loss_length"))


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    head = _HEAD.match(segment)
    name = head[1]
    back = {shown: role for role, shown in NAMES.items()}
    role = _ESCAPED.sub(r"\1", name[1:]) if name.startswith("=") else back[name]
    return role, _ESCAPED.sub(r"\1", segment[head.end() : -len("</turn>\n")])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """What rendered conversations say when read back: one row for each, made as a stream over its turns in order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def row() -> tuple:
            conv, n, turns, chars, loss, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for pdf in batches:
            done = []
            for conv, segment, start, length in zip(pdf["conv_id"], pdf["segment"], pdf["loss_start"], pdf["loss_length"], strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                lost = _ESCAPED.sub(r"\1", segment[start : start + length])
                state[3] += len(lost)
                state[4].update(lost.encode())
                state[5] += len(segment)
            yield pd.DataFrame(done, columns=[f.split()[0] for f in DIGEST.split(", ")])
        if state is not None:
            yield pd.DataFrame([row()], columns=[f.split()[0] for f in DIGEST.split(", ")])

    # ids travel as text: pandas would turn whole numbers beside a null into doubles
    ordered = segments.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), "first_seq", "segment", "loss_start", "loss_length").repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "segment")
    found = ordered.drop("first_seq").mapInPandas(read, DIGEST.replace("conv_id long", "conv_id string"))
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


def as_events(turns: DataFrame, *, chunk: int = 400) -> DataFrame:
    """A streamed log of finished turns (conv_id, turn, role, text): a start, then deltas of up to `chunk` characters.

    Longer assistant turns are preceded by a draft that a regeneration discards, other longer turns by one that an edit replaces.
    Turns alike in number are told apart by role and text; wholly equal ones stay separate turns.
    """
    from pyspark.sql import Window

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("msg", F.struct("turn", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("n")))
    event = lambda k, kind, text: F.struct(F.lit(k).cast("long").alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit(None).cast("string")
    long = (F.col("role") == "assistant") & (F.length("text") > chunk)
    edited = ~F.coalesce(F.col("role") == "assistant", F.lit(False)) & (F.length("text") > chunk)
    draft = event(1, "delta", F.substring("text", 1, chunk // 2))
    opening = F.when(long, F.array(event(0, "start", none), draft, event(2, "regenerate", none))).when(edited, F.array(event(0, "start", none), draft, event(2, "edit", F.substring("text", 1, chunk)))).otherwise(F.array(event(0, "start", none)))
    own = own.withColumn("first", edited.cast("int"))
    rest = F.expr(f"transform(sequence(first, cast(ceil(length(text) / {chunk}) as int)), i -> struct(cast(3 + i as long) as k, 'delta' as kind, substring(text, i * {chunk} + 1, {chunk}) as text))")
    events = own.select("conv_id", "msg", "role", F.explode(F.concat(opening, rest)).alias("e"))
    return events.select("conv_id", "msg", F.struct("msg", F.col("e.k").alias("k")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))
