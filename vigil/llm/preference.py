"""Preference formatting: one prompt and a masked pair of completions from two conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


SPANS = "array<struct<start:int,end:int,train:boolean>>"


def _length(turn: Column) -> Column:
    return F.length(_head(turn)) + F.length(_body(turn))


def mask(turns: Column) -> Column:
    """Spans (start, end, train) in characters over the rendered turns: a turn's header is never
    trained on, its text and end mark are if the role is ``TRAINED``.

    Turns are taken in blocks of about the square root of their number: arrays that grow by an entry
    are only as long as a block or the number of blocks.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(turns))).cast("int"), F.lit(1))
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(turns) - 1) / size).cast("int"), F.lit(0))), lambda k: F.slice(turns, k * size + 1, size)
    )

    def place(acc, block):
        end = acc["at"] + F.aggregate(block, F.lit(0), lambda n, t: n + _length(t))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("at"), block.alias("turns")))).alias("all"))

    def grow(acc, t):
        a = acc["at"]
        b = a + F.length(_head(t))
        c = b + F.length(_body(t))
        head = F.struct(a.alias("start"), b.alias("end"), F.lit(False).alias("train"))
        body = F.struct(b.alias("start"), c.alias("end"), (t["role"] == TRAINED).alias("train"))
        return F.struct(c.alias("at"), F.concat(acc["spans"], F.array(head, body)).alias("spans"))

    def spans(block):
        start = F.struct(block["at"].alias("at"), F.array().cast(SPANS).alias("spans"))
        return F.aggregate(block["turns"], start, grow, lambda acc: acc["spans"])

    none = F.slice(F.array(F.struct(F.lit(0).alias("at"), turns.alias("turns"))), 1, 0)
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("all")), place, lambda acc: acc["all"])
    return F.flatten(F.transform(placed, spans))


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(pair, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask), a row per pair.

    Turns are put in order by number, then role, then text (a null number first); null roles and
    texts count as empty. The prompt is the longest run of first turns that agree in role and text;
    what follows on either side is its completion. A pair that one table lacks has an empty
    conversation there, equal conversations leave two empty completions. A turn without a pair id
    belongs to no conversation: it is a pair of its own, the other side empty, and never grouped.
    Other input columns are left out. Empty tables give an empty result.
    """

    def side(df: DataFrame, k: int) -> DataFrame:
        role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
        turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
        return df.select(F.col(f"`{pair_col}`").alias(pair_col), F.lit(k).alias("_side"), turn.alias("_turn"))

    # a group holds the turns of one pair, which its output row holds as well
    turns = [F.sort_array(F.collect_list(F.when(F.col("_side") == k, F.col("_turn")))).alias(f"_{k}") for k in (0, 1)]
    both = side(chosen, 0).unionByName(side(rejected, 1))
    pairs = both.filter(F.col(f"`{pair_col}`").isNotNull()).groupBy(f"`{pair_col}`").agg(*turns)
    own = [F.filter(F.array(F.when(F.col("_side") == k, F.col("_turn"))), lambda t: t.isNotNull()).alias(f"_{k}") for k in (0, 1)]
    pairs = pairs.unionByName(both.filter(F.col(f"`{pair_col}`").isNull()).select(f"`{pair_col}`", *own))
    same = F.zip_with("_0", "_1", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differ = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("_shared", F.when(differ == 0, F.size("_0")).otherwise(differ - 1).cast("int"))

    def after(k: int) -> Column:
        turns = F.col(f"_{k}")
        return F.slice(turns, F.col("_shared") + 1, F.greatest(F.size(turns) - F.col("_shared"), F.lit(0)))

    return pairs.select(
        F.col(f"`{pair_col}`"),
        render(F.slice("_0", F.lit(1), F.col("_shared"))).alias("prompt"),
        F.col("_shared").alias("prompt_turns"),
        render(after(0)).alias("chosen"),
        render(after(1)).alias("rejected"),
        mask(after(0)).alias("chosen_mask"),
        mask(after(1)).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Rejected sides made of given conversations: the last assistant reply of conversation k gives
    way to that of conversation k xor 1 (empty where that has none); all other turns stay."""
    replies = conversations.filter(F.col("role") == TRAINED)
    last = replies.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    swap = last.join(other, "conv_id", "left").select(
        F.col("conv_id").alias("own"), F.col("last.turn").alias("at"), F.coalesce("other", F.lit("")).alias("other")
    )
    here = (F.col("turn") == F.col("at")) & (F.col("role") == TRAINED)
    return conversations.join(swap, F.col("conv_id") == F.col("own"), "left").select(
        "conv_id", "turn", "role", F.when(here, F.col("other")).otherwise(F.col("text")).alias("text")
    )
