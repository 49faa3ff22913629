r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds one row per event: a conversation, a message of it, a sequence number, a role, a kind and a text.
`fold` rebuilds the final messages, `render` turns a conversation into one string with loss spans, and `parse` reads
the string back.

Kinds: `message` (or null) starts a message or replaces it, `edit` and `regenerate` replace what was there, `delta`
appends. A message's text is its last replacing event's text and all later deltas, in order of seq.

Defined results: a null text or role counts as empty; a null seq sorts first; events that tie on seq are taken in the
order replacing before appending, then by text; a null conversation or message id is a value like any other; an empty
log gives an empty result; extra columns are left out, whatever their names; repeated rows count as often as they stand.

Template: every turn is `<|turn|>role<|text|>text<|end|>`. In roles and texts, every `\` is doubled and a `\` is put
behind every `<` and `[`, so that no marker (nor `</s>` or `[INST]`) can come from a text, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.expressions import let, running_sums

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """Make a text free of control strings; `unescape` is the exact inverse."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log with conv_id, message_id, seq, role, kind and text: conv_id, message_id, seq, role, text.

    The log is parted by conversation and message, and sorted by sequence: what comes before the last replacing event
    goes, and what is left is joined, in time linear in its length. So the messages of a long conversation are folded by
    many tasks. seq and role are those of the first event.
    """
    appends = F.coalesce(F.col("kind"), F.lit("message")) == "delta"
    log = events.select("conv_id", "message_id", "seq", appends.alias("appends"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    message = Window.partitionBy("conv_id", "message_id")
    ordered = message.orderBy("seq", "appends", "text", "role")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = log.withColumn("replaced", F.count_if(~F.col("appends")).over(so_far)).withColumn("at", F.row_number().over(ordered))
    marked = marked.withColumn("last", F.count_if(~F.col("appends")).over(message))
    marked = marked.withColumn("role", F.first("role").over(so_far)).withColumn("first_seq", F.first("seq").over(so_far))
    parts = marked.filter(F.col("replaced") == F.col("last")).groupBy("conv_id", "message_id").agg(F.first("first_seq").alias("seq"), F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return parts.select("conv_id", "message_id", "seq", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (array of start and end, in code points).

    Messages go in the order of seq, then of role and text. A span covers the escaped text of one message of `loss_role`.
    A conversation is one string, so its messages meet in one row, gathered by every task before the shuffle; where each
    begins is a running sum, in time linear in the number of turns.
    """
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == loss_role).alias("loss"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    sized = parts.select("conv_id", "parts", running_sums(F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))).alias("starts"))

    def span(part: Column, start: Column) -> Column:
        begin = start + F.length(part["head"])
        return F.when(part["loss"], F.struct(begin.alias("start"), (begin + F.length(part["body"])).alias("end")))

    return sized.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.filter(F.zip_with("parts", "starts", span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of role and text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        halves = F.split(F.regexp_replace(piece, r"<\|end\|>$", ""), r"<\|text\|>", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    The string is cut as UTF-32, where a place is found without a walk from the start.
    """
    cut = lambda wide: F.transform(spans, lambda s: unescape(F.decode(F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int")), "UTF-32")))
    return F.array_join(let(F.encode(formatted, "UTF-32"), cut), "")


def streamed(messages: DataFrame, size: int = 512) -> DataFrame:
    """A log in which every message (conv_id, message_id, seq, role, text) is streamed: it starts empty, and deltas of `size` code points follow.

    It is what `fold` turns into the same messages again. seq becomes a pair: that of the message, and the delta's place.
    """
    text = F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(text) - 1) / size).cast("int"))
    delta = lambda wide, i: F.struct((i + 1).alias("place"), F.lit("delta").alias("kind"), F.decode(F.substring(wide, i * (4 * size) + 1, F.lit(4 * size)), "UTF-32").alias("text"))
    deltas = let(F.encode(text, "UTF-32"), lambda wide: F.transform(starts, lambda i: delta(wide, i)))
    start = F.array(F.struct(F.lit(0).alias("place"), F.lit("message").alias("kind"), F.lit("").alias("text")))
    spread = messages.select("conv_id", "message_id", "seq", "role", F.explode(F.concat(start, deltas)).alias("e"))
    return spread.select("conv_id", "message_id", F.struct("seq", F.col("e.place").alias("place")).alias("seq"), "role", F.col("e.kind").alias("kind"), F.col("e.text").alias("text"))
