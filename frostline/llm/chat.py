"""Chat formatting by prefix-target expansion, with DataFrame functions only.

The template writes a conversation as one stream of formatted turns:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    other      [ROLE]role[=]text[/ROLE]

Inside a text (and a role) ``&``, ``<`` and ``[`` are written as ``&amp;``,
``&lt;`` and ``&lb;``, so no control string can occur there and the texts come
back exactly.

Every assistant turn is the target of one example: its context is the stream up
to the turn, written out, and the loss mask covers that reply alone.  Turns
after the last reply (all, without one) are in one example more, of no target
and no mask, so no turn is lost.  Contexts repeat what stands before them: the
output grows with the square of a conversation's length, by the method's nature.

The stream is cut into parts of ``CHARS_IN_PART`` characters, at turns, and an
example longer than a part is several rows: a row is bounded (but for a single
long turn), and a long conversation's examples are put together by many tasks.

Offsets are summed in two steps (inside blocks of turns, then over blocks), so
a conversation with a third of all rows is not one window.

Defined cases: null text and null role are empty strings; turns are ordered by
(turn, role, text), a null turn first, and repeated rows all count; rows with a
null conv_id form one conversation; a conversation without an assistant is one
example without a target; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;")]
# role -> (before, after)
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[=]", "[/ROLE]")
TURNS_IN_BLOCK = 512
CHARS_IN_PART = 1 << 14      # Spark reads 4,096 rows of a file at a time
# a whole turn of the stream: no text holds "<" or "["
TURN = (r"<<SYS>>[^<\[]*+<</SYS>>|\[INST\][^<\[]*+\[/INST\]|<s>[^<\[]*+</s>|"
        r"\[ROLE\][^<\[]*+\[=\][^<\[]*+\[/ROLE\]")


def escape(col: Column) -> Column:
    for plain, written in ESCAPES:
        col = F.replace(col, F.lit(plain), F.lit(written))
    return col


def unescape(col: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        col = F.replace(col, F.lit(written), F.lit(plain))
    return col


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per turn of ``rows(conv_id, turn, role, text)``: its piece of the
    stream with offsets, and on assistant turns the example it is the target of.

    Columns: conv_id, block, seg (place inside the block), formatted,
    char_start, char_end, stream_end (of the conversation), and for examples
    context_end, loss_start, loss_end.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    body = escape(text)
    formatted = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), body, F.lit(OTHER[2]))
    head = F.lit(0)
    for name, (before, after) in MARKS.items():
        formatted = F.when(role == name, F.concat(F.lit(before), body, F.lit(after))).otherwise(formatted)
    head = F.lit(len(MARKS["assistant"][0]))
    turns = rows.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / TURNS_IN_BLOCK), F.lit(-2**62)).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), formatted.alias("formatted"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    own = (turns.withColumn("seg", F.row_number().over(order).cast("long"))
           .withColumn("inside", F.sum(F.length("formatted").cast("long")).over(
               order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .withColumn("target", F.col("role") == "assistant").drop("text", "role", "turn"))
    blocks = turns.groupBy("conv_id", "block").agg(F.sum(F.length("formatted").cast("long")).alias("size"))
    before = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        (F.sum("size").over(Window.partitionBy("conv_id").orderBy("block")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("base"),
        F.sum("size").over(Window.partitionBy("conv_id")).alias("stream_end"))
    placed = own.join(before, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    end = F.col("base") + F.col("inside")
    start = end - F.length("formatted")
    mark = lambda c: F.when(F.col("target"), c)
    return placed.select(
        "conv_id", "block", "seg", "formatted", start.alias("char_start"), end.alias("char_end"), "stream_end",
        mark(start).alias("context_end"), mark(start + head).alias("loss_start"),
        mark(end - len(MARKS["assistant"][1])).alias("loss_end"))


def expand(formatted: DataFrame) -> DataFrame:
    """The examples of formatted turns, contexts written out: (conv_id,
    context_end, part, text, loss_start, loss_end, whole).

    (conv_id, context_end) is an example, its rows' texts in order of ``part``
    are its context and target.  The row that ends with the target has the loss
    mask, as offsets into its text.  ``whole`` examples end where their
    conversation does.
    """
    part = F.floor(F.col("char_start") / CHARS_IN_PART).cast("long")
    turns = formatted.withColumn("part", part)
    whole = F.col("char_end") == F.col("stream_end")
    # where examples end: at a target, or at the end of the conversation
    example = F.when(F.col("context_end").isNotNull() | whole, F.struct(
        F.coalesce("context_end", "char_end").alias("context_end"), "char_end", "loss_start", "loss_end", whole.alias("whole")))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("char_start", "formatted"))).getField("formatted"), "")
    own = (turns.groupBy("conv_id", "part").agg(F.min("char_start").alias("start"), text.alias("text"), F.collect_list(example).alias("e"))
           .select("conv_id", "part", "start", "text", F.explode("e").alias("e")))
    ends = own.select(
        "conv_id", "e.context_end", "part", F.substring("text", F.lit(1), (F.col("e.char_end") - F.col("start")).cast("int")).alias("text"),
        (F.col("e.loss_start") - F.col("start")).alias("loss_start"), (F.col("e.loss_end") - F.col("start")).alias("loss_end"), "e.whole")
    # the parts before, for examples that reach beyond the first
    later = (turns.filter("part > 0").select(F.col("conv_id").alias("c"), "part", example.alias("e")).filter("e is not null")
             .select("c", "e.context_end", "e.whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part") - 1)).alias("p")))
    filled = (turns.filter(F.col("stream_end") > (F.col("part") + 1) * CHARS_IN_PART)
              .groupBy("conv_id", "part").agg(text.alias("text")))
    before = filled.join(later, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        "conv_id", "context_end", "part", "text", F.lit(None).cast("long").alias("loss_start"),
        F.lit(None).cast("long").alias("loss_end"), "whole")
    return ends.unionByName(before)


def expand_examples(formatted: DataFrame) -> DataFrame:
    """The examples with a target, one row each: (conv_id, context_end, context,
    target)."""
    text = F.array_join(F.sort_array(F.collect_list(F.struct("part", "text"))).getField("text"), "")
    one = expand(formatted).groupBy("conv_id", "context_end").agg(text.alias("text"), F.max("loss_start").alias("masked"))
    end = F.col("context_end").cast("int")
    return one.filter("masked is not null").select(
        "conv_id", "context_end", F.substring("text", F.lit(1), end).alias("context"),
        F.col("text").substr(end + 1, F.length("text")).alias("target"))


def _read(turn: Column) -> Column:
    """A turn of the stream -> role, line feed, text, line feed."""
    inner = lambda m: turn.substr(F.lit(len(m[0]) + 1), F.length(turn) - len(m[0]) - len(m[1]))
    other = inner((OTHER[0], OTHER[2]))
    role = F.substring_index(other, OTHER[1], 1)
    text = other.substr(F.length(role) + len(OTHER[1]) + 1, F.length(other))
    for name, m in MARKS.items():
        role = F.when(turn.startswith(F.lit(m[0])), F.lit(name)).otherwise(role)
        text = F.when(turn.startswith(F.lit(m[0])), inner(m)).otherwise(text)
    return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))


def example_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read from its examples: number and digest of the turns
    and length of the stream (from the context and target of the example that
    reaches its end), length and digest of the text under the loss masks (of all
    examples).  A digest needs its conversation's text in order, so this (and
    only this) gathers it."""
    masked = unescape(F.col("text").substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.filter("whole or loss_start is not null").select(
        "conv_id", F.when(F.col("whole"), F.struct("part", "text")).alias("w"),
        F.when(F.col("loss_start").isNotNull(), F.struct("context_end", masked.alias("text"))).alias("l"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)).getField("text"), "")
    g = read.groupBy("conv_id").agg(joined("w").alias("stream"), joined("l").alias("loss"))
    g = g.withColumn("turns", F.regexp_extract_all("stream", F.lit(TURN), F.lit(0)))
    return g.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", _read), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("stream").cast("long").alias("formatted_chars"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """``example_digests`` of the examples of formatted turns."""
    return example_digests(expand(formatted))
