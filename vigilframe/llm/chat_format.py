"""Chat formatting with Spark expressions only (native).

A conversation is one string::

    <|im_start|>role\ntext<|im_sep|>text<|im_end|>\n ...

Adjacent turns of one role share a block; ``<|im_sep|>`` keeps their border. Inside texts every ``<`` that is
followed by backslashes and a bar gets one backslash more, so no text can hold a control string, and taking one
away again restores it. Roles are URL encoded, so they hold neither control strings nor line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted.

    Turns are ordered by turn (nulls first), then role and text, so ties have one result and repeated rows stay
    as separate turns. A null text or role is an empty one; rows with a null conversation id form one
    conversation. Other columns are ignored. No rows, no conversations.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    # each turn opens a block, or goes on with the block of the same role before it
    def part(x: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        opens = F.concat(F.when(before.isNull(), "").otherwise(END), F.lit(START), F.url_encode(x["role"]), F.lit("\n"))
        return F.concat(F.when(before == x["role"], F.lit(SEP)).otherwise(opens), escape(x["text"]))

    return sorted_turns.select("conv_id", F.concat(F.array_join(F.transform("turns", part), ""), F.lit(END)).alias("formatted"))


def parse_chats(formatted: DataFrame, conv: str = "conv_id", column: str = "formatted") -> DataFrame:
    """The inverse: conv_id, formatted and turns, an array of struct(role, text), read from the string alone."""
    blocks = F.filter(F.split(F.col(column), r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.url_decode(F.substring_index(body, "\n", 1))
        texts = F.split(F.substring(body, F.instr(body, "\n") + F.lit(1), F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select(F.col(conv).alias("conv_id"), F.col(column).alias("formatted"), F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def mask_expr(formatted: Column, trained_role: str = "assistant") -> Column:
    """Array of struct(start, length) in code points of the string: one span for each text of trained_role that is
    not empty, empty first texts of a block included. Control strings and roles are outside every span."""
    pieces = F.split(formatted, r"(?<=<\|im_start\|>)|(?=<\|im_start\|>)|(?=<\|im_end\|>)|(?<=<\|im_end\|>)|(?=<\|im_sep\|>)|(?<=<\|im_sep\|>)", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.lit(False).alias("on"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        opens = acc["before"] == START
        on = F.when(opens, F.url_decode(F.substring_index(piece, "\n", 1)) == trained_role).otherwise(acc["on"])
        head = F.when(opens, F.instr(piece, "\n")).otherwise(F.lit(0))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), (F.length(piece) - head).cast("int").alias("length"))
        spans = F.when((opens | ((acc["before"] == SEP) & ~piece.isin(SEP, END.strip()))) & on, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(piece)).cast("int").alias("at"), piece.alias("before"), on.alias("on"), spans.alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def with_loss_mask(formatted: DataFrame, column: str = "formatted", trained_role: str = "assistant") -> DataFrame:
    """The rows with loss_mask, the spans of mask_expr()."""
    return formatted.withColumn("loss_mask", mask_expr(F.col(column), trained_role))


def digests(formatted: DataFrame) -> DataFrame:
    """Read the strings back: counts and hashes of all turns, and of the text under the loss mask."""
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))))
    read = with_loss_mask(parse_chats(formatted)).select("conv_id", "turns", "formatted", loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
