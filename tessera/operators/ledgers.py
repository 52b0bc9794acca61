"""Ledgers of attempts and costs, quality of rankings, paired arms and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(attempts: DataFrame, request: str, order: str, retryable: Column, limit: int = 3, status: str = "status", cost: str = "cost") -> DataFrame:
    """One row for each request: ``n_attempts, spent, final_status, exhausted, in_order``.

    An attempt in flight costs one, others what they say (null: none).  The first attempt
    that is not ``retryable`` is final; anything after it puts the ledger out of
    order.  A request without one is exhausted once ``limit`` is spent.
    """
    spent = F.when(F.col(status) == "in_flight", F.lit(1)).otherwise(F.coalesce(F.col(cost), F.lit(0)))
    done = F.when(~F.coalesce(retryable, F.lit(False)), F.struct(order, status))
    found = attempts.groupBy(request).agg(F.count("*").alias("n_attempts"), F.sum(spent).alias("spent"), F.min(done).alias("_d"), F.max(order).alias("_last"))
    return found.select(
        request, "n_attempts", "spent", F.col(f"_d.{status}").alias("final_status"), (F.col("_d").isNull() & (F.col("spent") >= limit)).alias("exhausted"), F.coalesce(F.col(f"_d.{order}") == F.col("_last"), F.lit(True)).alias("in_order")
    )


def costs(attempts: DataFrame, stage: str, attempt: str, tokens: str = "tokens", price: str = "price") -> DataFrame:
    """Of each stage: its attempts, each once, what they report, and how many report nothing.

    Rows that repeat an attempt of a stage are inherited records and only counted.
    Unknown tokens and prices add nothing and are counted; where none is known the sum is null, not 0.
    """
    once = attempts.groupBy(stage, attempt).agg(F.count("*").alias("_n"), F.max(tokens).alias(tokens), F.max(price).alias(price))
    return once.groupBy(stage).agg(
        F.count("*").alias("n_attempts"),
        F.sum(F.col("_n") - 1).alias("inherited"),
        F.sum(tokens).alias("tokens"),
        F.count_if(F.col(tokens).isNull()).alias("unknown_tokens"),
        F.count(price).alias("priced"),
        F.count_if(F.col(price).isNull()).alias("unpriced"),
        F.round(F.sum(price), 6).alias("price"),
    )


def retrieval_quality(ranked: DataFrame, gold: DataFrame, query: str, key: str, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Of each query with gold keys: their number, recall at each depth, and the reciprocal rank of the first hit (0 without one)."""
    known = gold.select(query, key).distinct()
    hits = known.join(ranked.groupBy(query, key).agg(F.min("rank").alias("rank")), [query, key], "left")
    return hits.groupBy(query).agg(
        F.count("*").alias("n_gold"),
        *[F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"recall_{k}") for k in at],
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def paired_arms(scores: DataFrame, unit: str, arm: str, first: str, second: str, score: str = "score") -> DataFrame:
    """One row of the units that both arms have: ``n, wins, ties, losses, mean_difference`` of ``second`` against ``first``; ``unpaired`` counts the others."""
    value = lambda a: F.avg(F.when(F.col(arm) == a, F.col(score)))
    each = scores.where(F.col(arm).isin(first, second)).groupBy(unit).agg(value(first).alias("a"), value(second).alias("b")).withColumn("d", F.col("b") - F.col("a"))
    return each.agg(F.count("d").alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"), F.round(F.avg("d"), 6).alias("mean_difference"), F.count_if(F.col("d").isNull()).alias("unpaired"))


def leakage(rows: DataFrame, family: str, split: str) -> DataFrame:
    """Families that several splits have: ``(family, n_splits, n_rows)``."""
    return rows.groupBy(family).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def hash_checked(labels: DataFrame, packets: DataFrame, id: str, declared: str = "sha256", content: str = "text") -> DataFrame:
    """Labels with ``state``: ``matched`` where the packet of the id has the declared content, else ``changed`` or ``missing``."""
    actual = packets.select(id, F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("_h"))
    return labels.join(actual, id, "left").withColumn("state", F.when(F.col("_h").isNull(), "missing").when(F.col("_h") == F.col(declared), "matched").otherwise("changed")).drop("_h")


def session_budget(calls: DataFrame, session: str, order: str, size: str = "chars", max_calls: int = 12, max_call: int = 6_000, max_total: int = 24_000) -> DataFrame:
    """``calls`` with ``delivered`` characters: at most ``max_call`` of each of the first ``max_calls``, and ``max_total`` in all; invalid calls count with size 0."""
    w = Window.partitionBy(session).orderBy(order)
    asked = F.least(F.coalesce(F.col(size), F.lit(0)), F.lit(max_call))
    numbered = calls.withColumns({"call": F.row_number().over(w), "_a": asked})
    before = F.coalesce(F.sum(F.when(F.col("call") <= max_calls, F.col("_a"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(max_total) - before, F.lit(0))
    return numbered.withColumn("delivered", F.when(F.col("call") <= max_calls, F.least("_a", left)).otherwise(0)).drop("_a")
