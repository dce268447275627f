"""Chat formatting by event-sourced reconstruction. DataFrame functions only.

Events (conv_id, seq, event, msg_id, role, text) are folded into the final messages of each
conversation in the order of ``seq``:

* ``message`` starts a message (or sets it anew),
* ``delta`` appends its text to the message,
* ``edit`` replaces the message's text and drops the later messages that stood at that time,
* ``regenerate`` clears the message (its own text, if any, is the new start), and drops likewise.

The state of a message is the text of its last ``message``, ``edit`` or ``regenerate`` and of all
deltas after it; messages stand in the order of their first event. A message is dropped if one before
it was edited or regenerated after the message had begun.

Template. ``<|turn|>role<|says|>text<|end|>`` for each message, then a line feed. Control strings all
begin with ``<|``; inside roles and texts one backslash is put between ``<`` and ``|`` (and one more
where some stand there already), so ``<|`` in the output is always a control string and
:func:`unescape` restores every text exactly. The loss mask is the list of spans (first code point,
code points) of the assistants' texts in the output.

Defined cases: null text counts as empty, null role as empty, null event as ``message``, null msg_id
as ``seq``; events without conversation id belong to no conversation and are left out, turns without
one (:func:`format_conversations`) are each a conversation of their own; ties in ``seq`` are ordered
by event, then text; repeated rows of a message set it again (deltas append again); an empty table
gives an empty result; extra columns are ignored. A conversation is one row of output, so it must fit
into a task's memory; nothing larger is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, position from 0, role, text) of the final messages."""
    e = events.filter("conv_id IS NOT NULL").select(
        "conv_id", "seq", F.coalesce("event", F.lit("message")).alias("event"), F.coalesce("msg_id", "seq").alias("msg_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # The order of equal seq: an event that sets comes before the deltas of the same seq.
    e = e.withColumn("at", F.struct("seq", (F.col("event") == "delta").cast("int").alias("late"), "event", "text"))
    sets = F.col("event") != "delta"
    cuts = F.col("event").isin("edit", "regenerate")
    one = Window.partitionBy("conv_id", "msg_id")
    e = e.withColumn("set_at", F.max(F.when(sets, F.col("at"))).over(one)).withColumn("begun", F.min("at").over(one)).withColumn("cut_at", F.max(F.when(cuts, F.col("at"))).over(one))
    # The role is the first one that any event of the message names.
    e = e.withColumn("role", F.coalesce(F.min(F.when(F.col("role") != "", F.struct("at", "role"))).over(one)["role"], F.lit("")))
    live = e.filter(F.col("set_at").isNull() | (F.col("at") >= F.col("set_at")))
    messages = live.groupBy("conv_id", "msg_id", "begun", "cut_at", "role").agg(F.array_sort(F.collect_list(F.struct("at"))).alias("p"))
    # Equal sets of one place set the message once: only the last one's text counts.
    sets_in = F.filter("p", lambda x: x["at"]["event"] != "delta")
    deltas = F.filter("p", lambda x: x["at"]["event"] == "delta")
    text = F.concat(F.coalesce(F.get(sets_in, F.size(sets_in) - 1)["at"]["text"], F.lit("")), F.array_join(F.transform(deltas, lambda x: x["at"]["text"]), ""))
    messages = messages.select("conv_id", "begun", "cut_at", "role", text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("begun")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("last_cut", F.max("cut_at").over(earlier)).filter(F.col("last_cut").isNull() | (F.col("last_cut") < F.col("begun")))
    return messages.select("conv_id", (F.row_number().over(order) - 1).alias("position"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans: array of first code point and length) of each conversation."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    body = escape(F.col("text"))
    m = messages.withColumn("_head", head).withColumn("_body", body)
    m = m.withColumn("_line", F.concat("_head", "_body", F.lit(END + "\n"))).withColumn("_n", F.char_length("_line").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("position")
    m = m.withColumn("_start", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("_start") + F.char_length("_head")).alias("start"), F.char_length("_body").cast("long").alias("chars")))
    rows = F.array_sort(F.collect_list(F.struct("position", F.col("_line").alias("line"), span.alias("span"))))
    folded = m.groupBy("conv_id").agg(rows.alias("r"))
    return folded.select("conv_id", F.array_join(F.transform("r", lambda x: x["line"]), "").alias("formatted"), F.filter(F.transform("r", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of an output, array of (role, text)."""
    lines = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    part = lambda x, k: unescape(F.get(F.split(F.substring(x, F.lit(len(TURN) + 1), F.char_length(x)), r"<\|says\|>"), k))
    return F.transform(lines, lambda x: F.struct(part(x, 0).alias("role"), part(x, 1).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, restored, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["chars"].cast("int")))), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from plain turns (conv_id, turn, role, text): each turn is one ``message`` event.

    Rows that repeat a turn number are messages of their own, ordered by role and text.
    """
    # The key holds the id, and for turns without one where the row is read.
    key = F.struct("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"))
    keyed = turns.select(key.alias("conv_id"), "turn", "role", "text")
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    events = keyed.select("conv_id", F.struct(F.col("turn"), F.row_number().over(same).alias("nth")).alias("seq"), F.lit("message").alias("event"), F.lit(None).alias("msg_id"), "role", "text")
    events = events.withColumn("msg_id", F.col("seq"))
    return render(fold_events(events)).withColumn("conv_id", F.col("conv_id.conv_id"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the outputs hold, read back from them."""
    f = formatted.withColumn("_turns", parse(F.col("formatted"))).withColumn("_loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
