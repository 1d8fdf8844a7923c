"""Windows over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .records import top


def _budgeted(messages: DataFrame, budget: int) -> DataFrame:
    """User and assistant turns with whether they belong to the history that fits."""
    said = messages.where(F.col("role").isin("user", "assistant"))
    newest_first = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    fits = said.withColumn("fits", F.sum(F.length("text")).over(newest_first) <= budget)
    start = F.min(F.when(F.col("fits") & (F.col("role") == "user"), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return fits.withColumn("kept", F.col("fits") & F.coalesce(F.col("turn") >= start, F.lit(False))).drop("fits")


def select_history(messages: DataFrame, budget: int = 8000) -> DataFrame:
    """The last turns that fit a number of characters, from a user turn on."""
    return _budgeted(messages, budget).where("kept").drop("kept")


def overflow(messages: DataFrame, covered: DataFrame, budget: int = 8000) -> DataFrame:
    """Turns that don't fit and that no summary covers yet (conv_id, covered)."""
    return _budgeted(messages, budget).where("not kept").join(covered, "conv_id", "left").where(F.col("turn") > F.coalesce("covered", F.lit(-1))).drop("kept", "covered")


def recent_messages(messages: DataFrame, turns: int) -> DataFrame:
    """The last turns, a question and an answer each."""
    return top(messages, ["conv_id"], [F.desc("turn")], 2 * turns).drop("rank")


def unsummarised(messages: DataFrame, covered: DataFrame, most: int = 200) -> DataFrame:
    """The first turns after those that a summary covers."""
    rest = messages.join(covered, "conv_id", "left").where(F.col("turn") > F.coalesce("covered", F.lit(-1))).drop("covered")
    return top(rest, ["conv_id"], [F.asc("turn")], most).drop("rank")
