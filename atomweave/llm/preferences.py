"""Preference formatting of conversations, in DataFrame functions alone.

Method: of a chosen and a rejected conversation the longest common prefix of turns is rendered once as the prompt; the
turns after it are rendered as two completions with the stretches that a loss may count, the assistant's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.session import cut, shuffle_width

OPEN, CLOSE = ("<|", "|>\n"), "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN[0]), t["role"], F.lit(OPEN[1]), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """``[(start, end), ...]`` in code points of a completion: each assistant turn's text and its closing mark.

    One pass over the turns carries the end of the last one and the spans so far.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + len(OPEN[0] + OPEN[1])
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda state: state["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Format ``pairs(chosen, rejected, ...)``, two arrays of ``struct<role, text>``.

    Adds ``n_prompt_turns, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask``. Turns are equal if role and
    text are; null roles and texts count as empty, null conversations as having no turns. Equal conversations give two
    empty completions. Columns of the added names are replaced.
    """
    clean = lambda c: F.coalesce(F.transform(c, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), F.expr("cast(array() as array<struct<role:string,text:string>>)"))
    pairs = pairs.withColumns({"_c": clean(F.col("chosen")), "_r": clean(F.col("rejected"))})
    shared = F.transform(F.arrays_zip(F.slice("_c", 1, F.least(F.size("_c"), F.size("_r"))), F.slice("_r", 1, F.least(F.size("_c"), F.size("_r")))), lambda z: z["0"] == z["1"])
    differs = F.array_position(shared, F.lit(False)).cast("int")
    n = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("_c"), F.size("_r")))
    pairs = pairs.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    return pairs.withColumns({
        "prompt": _render(F.slice("_c", F.lit(1), F.col("n_prompt_turns"))),
        "chosen_text": _render(rest("_c")),
        "rejected_text": _render(rest("_r")),
        "chosen_mask": _mask(rest("_c")),
        "rejected_mask": _mask(rest("_r")),
    }).drop("_c", "_r")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from ``turns(conv_id, turn, role, text)``: ``conv_id, other_id, chosen, rejected``, one per conversation.

    Conversations of one first turn answer the same request: each is paired with the one before it (by conv_id, null
    last) in that group, as rejected. The first of a group is paired with itself cut short: its last turn ends after half
    of its code points. Conversations are ordered by turn; repeated turn numbers by role and text, repeated rows count
    as often as they occur. Turns without conv_id form one conversation. An empty table gives no pairs. Other columns are
    ignored. A conversation must fit a row; the groups of a first turn need not fit a task.
    """
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id")
    whole = whole.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))
    # The group of a conversation depends on its first turn; only hashes and ids are sorted.
    heads = whole.select("conv_id", F.xxhash64(F.get("chosen", F.lit(0))).alias("head"))
    # Ranges of (head, conv_id) spread a large group over tasks; the first of a range follows the last of the one before.
    order = F.col("conv_id").asc_nulls_last()
    heads = cut(heads.repartitionByRange(shuffle_width(heads.sparkSession), "head", order).withColumn("part", F.spark_partition_id()), "heads")
    lasts = heads.groupBy("head", "part").agg(F.max("conv_id").alias("last"))
    lasts = lasts.select("head", "part", F.lag("last").over(Window.partitionBy("head").orderBy("part")).alias("before"))
    within = F.lag("conv_id").over(Window.partitionBy("head", "part").orderBy(order))
    partner = heads.withColumn("within", within).join(lasts, ["head", "part"]).select(F.col("conv_id").alias("own"), F.coalesce("within", "before").alias("other_id"))
    other = whole.select(F.col("conv_id").alias("other_id"), F.col("chosen").alias("other"))
    paired = whole.join(partner, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", "other_id", "chosen")
    # Rows without a partner get keys of their own that meet nothing: null keys would all go to one task.
    key = F.when(F.col("other_id").isNull(), F.concat(F.lit("alone "), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("to "), F.col("other_id").cast("string")))
    other = other.where("other_id is not null").select(F.concat(F.lit("to "), F.col("other_id").cast("string")).alias("key"), "other")
    paired = paired.withColumn("key", key).join(other, "key", "left")
    last = F.element_at("chosen", -1)
    half = F.struct(last["role"].alias("role"), F.substring(last["text"], F.lit(1), F.floor(F.length(last["text"]) / 2).cast("int")).alias("text"))
    short = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(half))
    return paired.select("conv_id", "other_id", "chosen", F.coalesce("other", short).alias("rejected"))
