"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A conversation is a log of events, in order of `seq`. Each event is about one message of it:

* message: starts the message with a role and a text
* delta: appends a streamed piece of text
* edit: replaces the text
* regenerate: discards the text; deltas that follow build it anew (a text of its own starts it)

The final text is what was appended since the last event that isn't a delta; the role is the last one
that was named. Messages are rendered as `### role: text</turn>\\n` in order of their number, and the
assistant's texts are the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, BETWEEN, TAIL = "### ", ": ", "</turn>\n"
#: What is escaped inside texts, in this order; undone in the reverse order. No escape contains another's source.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replaced(c: Column, pairs: tuple) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column, escapes: tuple = ESCAPES) -> Column:
    return _replaced(c, escapes)


def unescape(c: Column, escapes: tuple = ESCAPES) -> Column:
    return _replaced(c, tuple((new, old) for old, new in reversed(escapes)))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, kind, role, text) -> (conv_id, message, role, text), one row per message.

    Null texts are empty; a message none of whose events names a role has the empty role. Events
    with equal seq go by kind, role and text. A null conv_id or message number is a value of its own.
    The number of shuffles is one: events meet by conversation and message.
    """
    one = F.struct(F.col("seq"), F.col("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(one)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e.kind != "delta", i + 1).otherwise(0))
    since = F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1))
    logs = logs.withColumn("since", since)
    pieces = F.transform(F.slice("log", F.col("since"), F.size("log") - F.col("since") + 1), lambda e: e.text)
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return logs.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(pieces, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) -> (conv_id, formatted, loss_mask array<struct<start, length>>), a row per conversation.

    Offsets are code points from 0. A rendered conversation is one value, so its messages meet in one row.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(BETWEEN))
    blocks = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(TAIL)
    blocks = blocks.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)))
    one = F.struct("message", "at", F.concat("head", "body", F.lit(TAIL)).alias("block"), (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), (F.col("role") == "assistant").alias("loss"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    mask = F.transform(F.filter("blocks", lambda b: b.loss), lambda b: F.struct(b.start.alias("start"), b.length.alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("blocks", lambda b: b.block), "").alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """What render() wrote -> array<struct<role, text>>."""
    turns = F.split(formatted, TAIL)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    inside = F.transform(turns, lambda t: F.substring(t, len(HEAD) + 1, 2**31 - 1))
    return F.transform(
        inside,
        lambda t: F.struct(
            unescape(F.substring_index(t, BETWEEN, 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, BETWEEN, 1)) + len(BETWEEN) + 1)).alias("text"),
        ),
    )


def under_mask(formatted: Column, loss_mask: Column) -> Column:
    """The texts that the loss mask covers, unescaped, with nothing between."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substr(formatted, (m.start + 1).cast("int"), m.length.cast("int")))), "")


def turns_as_events(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """A table of whole turns as the log of how they came about, in pieces of `piece` code points.

    An assistant's message starts empty, streams its first piece, is regenerated, and streams its whole text in deltas. Any
    other message starts with its first piece as a draft, is edited to nothing, and then streams its text. Rows of equal turn
    go by role and text. A null or empty text has no drafts and no deltas.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    first = F.shiftleft("message", 32)  # of the message's numbers in the log
    event = lambda at, kind, role, text: F.struct(at.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.alias("text"))
    none = F.lit(None)
    numbered = numbered.withColumn("pieces", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{piece}}}"), 0)).withColumn("draft", F.get("pieces", F.lit(0)))
    spoken = F.array(event(first, "message", F.col("role"), F.lit("")), event(first + 1, "delta", none, F.col("draft")), event(first + 2, "regenerate", none, none.cast("string")))
    written = F.array(event(first, "message", F.col("role"), F.col("draft")), event(first + 2, "edit", none, F.lit("")))
    opening = F.when(F.col("draft").isNull(), F.array(event(first, "message", F.col("role"), F.lit("")))).when(F.col("role") == "assistant", spoken).otherwise(written)
    log = F.concat(opening, F.transform("pieces", lambda p, i: event(first + i + 3, "delta", none, p)))
    return numbered.select("conv_id", "message", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "e.role", "e.text")
