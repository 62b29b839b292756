"""Operators on message logs ``(conv_id, seq, role, content, ...)``, all of them native windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("input_tokens", "output_tokens", "total_tokens", "llm_calls", "cache_creation_input_tokens", "cache_read_input_tokens")
# Fixed value: the words "previous iteration". The rest is this engine's own.
SUMMARY = "[{} previous iteration(s) left out here for length. What they wrote is in the document, which inspect_keys shows as it is now.]"


def trim(log: DataFrame, keep: int = 2, key: str = "conv_id", order: str = "seq", ai: str = "ai", human: str = "human", system: str = "system") -> DataFrame:
    """The messages that stay of logs with more than ``keep`` rounds, with ``is_summary`` rows for what went.

    A round begins with a message of the model. What stays are system messages and the first human one before any round,
    a summary, and the last ``keep`` rounds. Logs with fewer rounds do not appear.
    """
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    numbered = log.withColumn("_round", F.sum((F.col("role") == ai).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.withColumn("_rounds", F.max("_round").over(whole)).filter(F.col("_rounds") > keep)
    first = F.min(F.when((F.col("role") == human) & (F.col("_round") == 0), F.col(order))).over(whole)
    kept = numbered.withColumn("_first", first).filter(
        ((F.col("_round") == 0) & ((F.col("role") == system) | (F.col(order) == F.col("_first")))) | (F.col("_round") > F.col("_rounds") - keep)
    )
    before, after = SUMMARY.split("{}")
    text = F.concat(F.lit(before), (F.col("_rounds") - keep).cast("string"), F.lit(after))
    # The summary takes the place of the last message that went.
    summary = numbered.filter((F.col("_round") > 0) & (F.col("_round") <= F.col("_rounds") - keep)).groupBy(key, "_rounds").agg(F.max(order).alias(order))
    summary = summary.select(key, order, F.lit(human).alias("role"), text.alias("content"), F.lit(True).alias("is_summary"))
    return kept.select(key, order, "role", "content", F.lit(False).alias("is_summary")).unionByName(summary)


def last_ai(log: DataFrame, key: str = "conv_id", order: str = "seq", ai: str = "ai") -> DataFrame:
    """The last message of the model in each log."""
    return log.filter(F.col("role") == ai).groupBy(key).agg(F.max_by("content", order).alias("content"), F.max(order).alias(order))


def since_reset(log: DataFrame, key: str = "conv_id", order: str = "seq", system: str = "system") -> DataFrame:
    """The messages from the last system message on: a system message begins a log anew."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = log.withColumn("_part", F.sum((F.col("role") == system).cast("int")).over(w))
    return part.withColumn("_last", F.max("_part").over(Window.partitionBy(key))).filter("_part = _last").drop("_part", "_last")


def token_usage(calls: DataFrame, key: str) -> DataFrame:
    """Sums of the six usage counters, missing ones as 0; a call without any usage is no call."""
    has = F.greatest(*[F.col(c).isNotNull().cast("int") for c in USAGE if c in calls.columns and c != "llm_calls"]) == 1
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) if c in calls.columns else F.lit(0).cast("long").alias(c) for c in USAGE if c != "llm_calls"]
    return calls.groupBy(key).agg(*sums[:3], F.count_if(has).alias("llm_calls"), *sums[3:])


def tool_counts(calls: DataFrame, *keys: str) -> DataFrame:
    """How often each tool was called, most often first."""
    return calls.groupBy(*keys, "tool").agg(F.count(F.lit(1)).alias("n")).orderBy(*keys, F.col("n").desc(), "tool")


def short_number(n):
    """1234567 as 1.2M and 3400 as 3.4k."""
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1_000_000, 1).cast("decimal(20,1)").cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("k"))).otherwise(n.cast("string"))
