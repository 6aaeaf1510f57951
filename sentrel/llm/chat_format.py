"""Chat formatting with Spark expressions only.

The template marks each run of turns of one role as ``<|im_start|>role<|im_msg|>text<|im_end|>`` and a line end;
adjacent turns of the same role share one block, with ``<|im_sep|>`` between their texts. Inside roles and texts a
backslash is doubled and then one backslash is put after the first character of whatever could be read as a control
string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so no text can end a turn and all texts can be read back.

Defined cases: a null text or role is the empty string; rows of equal conversation and turn are ordered by role, then
text; null turns come first; a null conv_id is a conversation of its own; other columns are ignored; an empty table
gives no rows. Long conversations are formatted in pieces of at most ``TURNS`` turns, also where turns have one number or none, and
the pieces are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings and the strings that are escaped.
START, MSG, SEP, END = "<|im_start|>", "<|im_msg|>", "<|im_sep|>", "<|im_end|>\n"
CONTROL = r"(\||/?s>|/?INST\])"

#: A piece holds turns whose numbers agree up to this divisor, and at most so many.
TURNS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[]){CONTROL}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\{CONTROL}", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _spans(parts: Column, lead: Column, at: Column) -> Column:
    """Loss spans (start, length; code points from 0) of the assistant texts among ``parts``, which begin at ``at`` + ``lead``."""
    begin = lambda i: at + lead + F.aggregate(F.slice(parts, 1, i), F.lit(0).cast("long"), lambda a, p: a + p["size"])
    found = F.transform(parts, lambda p, i: F.struct((begin(i) + p["head"]).alias("start"), (p["size"] - p["head"]).alias("length"), p["loss"].alias("loss")))
    return F.transform(F.filter(found, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length over code points of ``formatted``)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.floor(F.col(turn) / TURNS).alias("_piece"),
        F.struct(F.col(turn).isNotNull().alias("timed"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("_turn"),
    )
    # The same exchange serves the numbering and the grouping.
    order = Window.partitionBy("conv_id", "_piece").orderBy("_turn")
    rows = rows.withColumn("_part", F.floor((F.row_number().over(order) - 1) / TURNS))
    pieces = rows.groupBy("conv_id", "_piece", "_part").agg(F.sort_array(F.collect_list("_turn")).alias("t"))

    def part(x: Column, i: Column) -> Column:
        """A turn's text with what stands before it; a piece's first turn gets its header when pieces are joined."""
        before = F.element_at(F.col("t"), F.greatest(i, F.lit(1)))
        head = F.when(i == 0, F.lit("")).when(before["role"] == x["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END + START), escape(x["role"]), F.lit(MSG)))
        body = F.concat(head, escape(x["text"]))
        return F.struct(body.alias("body"), F.length(body).cast("long").alias("size"), F.length(head).cast("long").alias("head"), (x["role"] == "assistant").alias("loss"))

    pieces = pieces.withColumn("parts", F.transform("t", part)).select(
        "conv_id",
        F.struct(
            F.col("_piece").isNotNull().alias("timed"), F.col("_piece").alias("piece"), F.col("_part").alias("part"),
            F.element_at("t", 1)["role"].alias("first"), F.element_at("t", -1)["role"].alias("last"),
            F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("body"),
            _spans(F.col("parts"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("spans"),
        ).alias("_p"),
    )
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("_p")).alias("p"))

    def joined(x: Column, i: Column) -> Column:
        before = F.element_at(F.col("p"), F.greatest(i, F.lit(1)))
        head = F.when((i > 0) & (before["last"] == x["first"]), F.lit(SEP)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape(x["first"]), F.lit(MSG)))
        return F.struct(F.concat(head, x["body"]).alias("body"), F.length(head).cast("long").alias("head"), (F.length(head) + F.length(x["body"])).cast("long").alias("size"), x["spans"].alias("spans"))

    whole = whole.withColumn("q", F.transform("p", joined))
    begins = F.aggregate("q", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["size"])))
    moved = lambda at: F.flatten(F.transform("q", lambda x, i: F.transform(x["spans"], lambda s: F.struct((F.get(at, i) + x["head"] + s["start"]).alias("start"), s["length"].alias("length")))))
    spans = F.transform(F.array(begins), moved)[0]  # the outer array binds the offsets, so that they are found once
    return whole.select("conv_id", F.concat(F.array_join(F.transform("q", lambda x: x["body"]), ""), F.lit(END)).alias("formatted"), spans.alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array of (role, text), unescaped."""
    blocks = F.split(F.left(formatted, F.length(formatted) - F.lit(len(END))), r"<\|im_end\|>\n", -1)
    headed = F.transform(blocks, lambda b: F.split(F.substring(b, len(START) + 1, 2147483647), r"<\|im_msg\|>", 2))
    return F.flatten(F.transform(headed, lambda b: F.transform(F.split(b[1], r"<\|im_sep\|>", -1), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text")))))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
