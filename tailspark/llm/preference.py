"""Preference formatting: one prompt and two masked completions per pair of conversations.

Native DataFrame expressions only.  The longest common turn prefix of the chosen and the
rejected conversation is rendered once as the prompt; the rest of each is its completion,
with the ranges of assistant text, on which alone loss is taken.

Scale: one shuffle by pair on each side and a join on the same key; a pair's turns are one
sample and so one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def _turns(rows: DataFrame, name: str) -> DataFrame:
    """pair_id and the sorted turns (turn, role, text); rows that repeat a turn wholly count once."""
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.filter(F.col("pair_id").isNotNull()).groupBy(F.col("pair_id").alias(f"{name}_id")).agg(F.array_sort(F.collect_set(one)).alias(name))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """start:end of each assistant text in the rendered completion, comma-joined; characters, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + len(OPEN) + 1 + F.length(t["role"])
        last = first + F.length(t["text"])
        span = F.array(F.concat_ws(":", first.cast("string"), last.cast("string")))
        return F.struct((last + len(CLOSE)).alias("at"), F.when(t["role"] == LEARNT, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["out"], ","))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of conversations (pair_id, turn, role, text) as prompt and completions.

    Turns are ordered by turn (null first), then role and text; null role and text count as
    empty.  Turns are common if role and text agree.  A conversation without a partner has an
    empty one; equal conversations leave both completions empty.  Rows without pair_id belong
    to no conversation.  Other columns are ignored.
    """
    c, r = _turns(chosen, "chosen"), _turns(rejected, "rejected")
    none = F.array().cast(c.schema["chosen"].dataType)
    both = c.join(r, F.col("chosen_id") == F.col("rejected_id"), "full_outer").select(F.coalesce("chosen_id", "rejected_id").alias("pair_id"), F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: (i < shorter) & ((F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])))
    split = both.withColumn("n", F.coalesce(F.array_min(at), shorter))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    return split.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"),
        _mask(rest("c")).alias("chosen_mask"),
        _render(rest("r")).alias("rejected"),
        _mask(rest("r")).alias("rejected_mask"),
    )


def stale_answers(turns: DataFrame) -> DataFrame:
    """Rejected partners: the last assistant turn gives the conversation's first assistant text again, or nothing if it is the first."""
    own = turns.filter(F.col("role") == LEARNT).groupBy(F.col("pair_id").alias("of")).agg(F.max("turn").alias("last"), F.min(F.struct("turn", "text")).alias("first"))
    met = turns.join(own, turns["pair_id"] == own["of"], "left")
    swap = (F.col("role") == LEARNT) & (F.col("turn") == F.col("last"))
    old = F.when(F.col("first.turn") == F.col("last"), "").otherwise(F.col("first.text"))
    return met.select("pair_id", "turn", "role", F.when(swap, old).otherwise(F.col("text")).alias("text"))


def op8_preference_pairs(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return format_pairs(turns, stale_answers(turns))
