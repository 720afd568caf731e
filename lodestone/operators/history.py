"""Conversations: sliding history, rolling summaries, the question before each answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(turns: DataFrame, max_turns: int = 20) -> DataFrame:
    """For each user turn the messages that the model sees: the last ``2 * max_turns`` up to it.

    ``conv_id, turn`` (the user's), ``position`` (from 1), ``role, text``. Only user and assistant messages count.
    """
    most = 2 * max_turns
    said = turns.filter(F.col("role").isin("user", "assistant"))
    over = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(most - 1), 0)
    # Each message carries a window of bounded length, so nothing is joined to itself.
    seen = said.withColumn("seen", F.collect_list(F.struct("role", "text")).over(over)).filter("role = 'user'")
    return seen.select("conv_id", "turn", F.posexplode("seen").alias("p", "m")).select("conv_id", "turn", (F.col("p") + 1).cast("bigint").alias("position"), "m.role", "m.text")


def question_before(turns: DataFrame) -> DataFrame:
    """Each assistant message with the last user message before it (null if there is none)."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return turns.withColumn("question", asked).filter("role = 'assistant'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def summary_prompts(turns: DataFrame, every: int = 5, last: int = 10, cut: int = 200, least: int = 4) -> DataFrame:
    """At each ``every``-th answer the text to summarise: the last messages, each cut short; fewer than ``least`` give none."""
    said = turns.filter(F.col("role").isin("user", "assistant"))
    over = Window.partitionBy("conv_id").orderBy("turn")
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, cut))
    said = said.withColumns({"answers": F.count(F.when(F.col("role") == "assistant", 1)).over(over), "lines": F.collect_list(line).over(over.rowsBetween(-(last - 1), 0))})
    due = said.filter((F.col("role") == "assistant") & (F.col("answers") % every == 0) & (F.size("lines") >= least))
    return due.select("conv_id", "turn", F.array_join("lines", "\n").alias("prompt"))
