"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation again after each turn, so that one log is a
prefix of the next. Each turn gets the hash of the prefix that ends with it
(rolling: the exclusive or of the turns' own hashes, which include their
places). A conversation whose last hash is the hash of a proper prefix of
another is a snapshot of that one; an anti-join drops it. Of equal
conversations, the smallest id stays. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"  # fixed values: the marks of the ChatML format


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def prefixes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, role, text, h1, h2): each turn with the hashes of the prefix it ends.

    Turns are ordered by number, then role and text; nulls come first and count
    as empty. Repeated turns are turns of their own.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(by))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id", "place", "role", "text",
        F.bit_xor(F.xxhash64(F.lit(1), "place", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), "text", "place", "role")).over(so_far).alias("h2"),
    )


def collapse(marked: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations of ``prefixes``."""
    size = Window.partitionBy("conv_id")
    narrow = cut(marked.select("conv_id", "place", "h1", "h2", F.max("place").over(size).alias("n")), "turn-prefixes")
    whole = narrow.where("place = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = narrow.where("place < n").select(F.col("place").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def chat_format(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): the maximal conversations, rendered in ChatML.

    n_copies: how many conversations were equal to it. Rows with a null id make
    one conversation, with a null id.
    """
    marked = prefixes(turns, id_col, turn_col, role_col, text_col)
    kept = cut(collapse(marked), "maximal")
    mine = kept.select(F.col("conv_id").alias("k"), "n_turns", "n_copies")
    lines = marked.join(mine, marked.conv_id.eqNullSafe(F.col("k")))
    told = lines.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    chat = F.array_join(F.transform("t", lambda x: turn(x["role"], x["text"])), "")
    return told.select(F.col("conv_id").alias(id_col), "n_turns", "n_copies", chat.alias("chat"))
