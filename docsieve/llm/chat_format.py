"""Conversations rebuilt from their event log and rendered with a chat template, in DataFrame functions only.

The log has a row per event: ``message`` (a whole text), ``delta`` (a streamed piece), ``edit``
(a new text) and ``regenerate`` (the turn starts again, all later turns written before it are
void).  The log is partitioned by conversation and block of turns, one exchange.  An event counts
if no later ``message``, ``edit`` or ``regenerate`` of its turn replaced it and no later
``regenerate`` of an earlier turn voided it; the texts that count, joined in order of their
sequence, are the turn's text.

Long conversations are several segments of ``SEGMENT`` turns each, so that no task gets a whole
conversation of any length; what a segment must know of earlier ones, the last ``regenerate`` among
lower turns, is a number a segment, found by a running maximum over segments.

Template: ``<|turn|>role<|text|>text<|end|>`` a turn.  Inside roles and texts a backslash is
doubled, and one is put after the first character of every control string; ``unescape`` drops a
backslash and keeps the character behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are rendered together.
SEGMENT = 256
#: Streamed pieces that ``as_events`` cuts an assistant's text into have this many code points.
DELTA = 1024
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Never left whole inside a text: the template's marks and those of other templates.
CONTROLS = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RESETS = ("message", "edit", "regenerate")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_<>/" else "\\" + c for c in text)


def escape(text: Column) -> Column:
    """``text`` without any control string, reversibly (see ``unescape``)."""
    opened = "([<\\[])(?=" + "|".join(_quoted(c[1:]) for c in CONTROLS if c[0] == "<") + "|" + "|".join(_quoted(c[1:]) for c in CONTROLS if c[0] == "[") + ")"
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), opened, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_events(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log behind a table of finished turns (conv_id, turn, role, text), every row a turn of its own.

    An assistant's text arrives as an empty message and its pieces of ``delta`` code points, any
    other text as one message.  Rows of one turn number follow each other by role and text hash.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")).alias("part"))
    event = lambda seq, kind, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    pieces = F.when(F.col("role") == "assistant", F.concat(
        F.array(event(F.lit(0), "message", F.lit(""))), F.transform(cut, lambda piece, i: event(i + 1, "delta", piece)))).otherwise(
        F.array(event(F.lit(0), "message", F.col("text"))))
    events = rows.select("conv_id", "turn", "part", "role", F.explode(pieces).alias("e"))
    return events.select("conv_id", "turn", "part", "e.seq", "role", "e.kind", "e.text")


def reconstruct(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Final messages of a log: conv_id, segment, last_segment, turn, part, role, text.

    ``events`` has conv_id, turn, seq (order within the conversation), role, kind, text, and
    optionally part (any orderable value) where a turn number stands for several messages.
    Null kinds count as ``message``, null texts as empty, a null turn comes first and a null seq
    before all others; events of one seq go by their text.  Unknown kinds change nothing.  A turn
    of which no event counts is no message.  The role is the least of the turn's events that count.
    Null conversation ids are one conversation.  Extra columns are ignored; an empty log gives no rows.
    """
    part = F.col("part") if "part" in events.columns else F.lit(0).alias("part")
    log = events.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.expr(f"cast(turn as bigint) div {segment}"), F.lit(-(1 << 62))).alias("segment"), F.col("turn").cast("long").alias("turn"), part,
        F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"), "role", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text")).filter(F.col("kind").isin(*_RESETS, "delta"))
    restart = F.when(F.col("kind") == "regenerate", F.col("seq"))
    conversation = Window.partitionBy("conv", "no_id")
    segments = log.groupBy("conv", "no_id", "segment").agg(F.max(restart).alias("restart")).select(
        "conv", "no_id", "segment", F.max("segment").over(conversation).alias("last_segment"), F.min("segment").over(conversation).alias("first_segment"),
        F.max("restart").over(conversation.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)).alias("voided_before"))
    own = Window.partitionBy("conv", "no_id", "segment")
    message = Window.partitionBy("conv", "no_id", "segment", "turn", "part")
    lower = own.orderBy(F.col("turn").cast("decimal(20,0)")).rangeBetween(Window.unboundedPreceding, -1)  # no overflow at the least long
    live = (log.join(segments, ["conv", "no_id", "segment"])
            .withColumn("voided", F.greatest("voided_before", F.max(restart).over(lower)))
            .withColumn("reset", F.max(F.when(F.col("kind").isin(*_RESETS), F.col("seq"))).over(message))
            .filter("(voided is null or seq > voided) and (reset is null or seq >= reset)"))
    pieces = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return live.groupBy("conv", "no_id", "segment", "turn", "part").agg(
        F.min("role").alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        F.first("last_segment").alias("last_segment"), F.first("first_segment").alias("first_segment"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted segments of ``reconstruct``'s messages: conv_id, segment, alone, formatted, loss_spans.

    ``loss_spans`` are (start from 0, length) in code points of ``formatted``: the escaped texts of
    ``trained`` roles, no marks.  ``alone`` says that the conversation has this segment only.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.col("text"))
    turns = messages.select(
        "conv", "no_id", "segment", "last_segment", "first_segment", "turn", "part", F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("head"), text.alias("body"),
        F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("trained"))
    marks = F.struct("turn", "part", "head", "body", "trained")
    folded = turns.groupBy("conv", "no_id", "segment").agg(
        F.sort_array(F.collect_list(marks)).alias("turns"), (F.first("first_segment") == F.first("last_segment")).alias("alone"))
    size = F.transform("turns", lambda t: F.struct(
        (F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)).alias("all"), F.char_length(t["head"]).alias("head"), F.char_length(t["body"]).alias("body"), t["trained"].alias("trained")))
    # (place of the next turn, spans so far), folded over the turns
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    spans = F.aggregate("size", start, lambda a, t: F.struct(
        (a["at"] + t["all"]).alias("at"),
        F.when(t["trained"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return folded.withColumn("size", size).select(
        F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), "segment", "alone",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Event log to formatted segments (see ``reconstruct`` and ``render``).

    Null and empty texts are empty turns; very long texts are kept whole (a segment must fit a row);
    repeated events of a turn are joined like any other, since a log holds what was sent.
    """
    return render(reconstruct(events, segment))


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``formatted`` (of ``render``) says, per segment: the turns, and the text under the loss mask, both unescaped."""
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"))
    pieces = F.slice(F.split("formatted", _quoted(TURN)), 2, 1 << 30)
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "segment", "alone", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss"),
                            F.char_length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation, read back from the formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations of one segment need no further exchange; the segments of longer ones meet per
    conversation, since a digest is over the whole conversation (its text must fit a row).
    """
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_back(format_conversations(events, segment)).select(
        "conv_id", "segment", "alone", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), "loss", "formatted_chars")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", c))), lambda s: s[c]), "").alias(c)
    longer = parts.filter("not alone").groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), joined("spoken"), joined("loss"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = parts.filter("alone").select(longer.columns).unionByName(longer)
    return whole.select("conv_id", "n_turns", F.sha2("spoken", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
