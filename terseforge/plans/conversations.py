"""Conversations: lines, articles of four or more rounds, prompts, last responses and role units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.functions import text as T

#: Conversations of fewer rounds are left out.
LEAST_ROUNDS = 4


def turns_once(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: each turn once (the first row sent), roles without case and blanks.

    Pre-aggregated before the shuffle, so rows sent many times do not gather in one task.
    """
    first = F.min_by(F.struct("role", "text"), "turn_id")
    return turns.groupBy("conv_id", "turn").agg(first.alias("r")).select("conv_id", "turn", F.lower(F.trim("r.role")).alias("role"), F.coalesce("r.text", F.lit("")).alias("text"))


def assembled(turns: DataFrame) -> DataFrame:
    """conv_id, num_rounds, said array<struct<turn, role, text>> in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said")).withColumn("num_rounds", F.size("said"))


def articles(turns: DataFrame, least: int = LEAST_ROUNDS) -> DataFrame:
    """conv_id, num_rounds, text (lines of all turns), prompt (lines of all but the last), response (the last)."""
    made = assembled(turns).where(F.col("num_rounds") >= least)
    lines = F.transform("said", lambda u: T.utterance_line(u["role"], u["text"]))
    chat = F.array_join(F.transform(F.slice("said", 1, F.col("num_rounds") - 1), lambda u: F.concat(u["role"], F.lit(": "), u["text"], F.lit("\n"))), "")
    return made.select("conv_id", "num_rounds", F.array_join(lines, "\n").alias("text"), F.concat(chat, F.lit("gpt: ")).alias("prompt"), F.element_at("said", -1)["text"].alias("response"))


def role_units(turns: DataFrame, score: float = 100.0) -> DataFrame:
    """The sentinel units that head every utterance: conv_id, turn, text, self_info."""
    return turns.where("text <> ''").select("conv_id", "turn", F.concat(F.lit(" "), F.col("role"), F.lit(": ")).alias("text"), F.lit(score).alias("self_info"))
