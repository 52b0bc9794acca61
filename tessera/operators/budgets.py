"""Budgets of recorded sessions: accounts of turns, excerpts that shrink, and reviews of paired arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.delivery import json_chars

#: Characters that an excerpt is cut by beyond what is needed, so that its mark as incomplete fits.  Fixed value.
SLACK = 20


def turn_accounts(turns: DataFrame, by: str, window: int = 32_768, most: int = 13) -> DataFrame:
    """``(by, status, n_turns, counted_input, completion)``: how each recorded session ended and what it had used by then.

    ``turns`` is ``(by, turn, counted, max_tokens, status, same_model, prompt,
    completion, finish, action)`` from turn 0.  The first turn with one of these
    reasons ends the session: its input and reply don't fit the window (not asked,
    so not counted); it got no response; another model answered; usage is unknown;
    the provider counted other tokens; the reply exceeds its budget (its tokens
    don't count); it was cut; it holds no action; its action is ``final``.  Without
    such a turn the session is ``turn_budget_exhausted``, or ``open`` before ``most``.
    """
    counted, reply = F.col("counted"), F.col("completion")
    usage = lambda c, low: F.coalesce(F.col(c) >= low, F.lit(False))
    reason = (
        F.when(counted + F.col("max_tokens") > window, "input_budget_exhausted")
        .when(~F.col("status").eqNullSafe("response"), F.coalesce("status", F.lit("unknown")))
        .when(~F.coalesce("same_model", F.lit(False)), "model_identity_mismatch")
        .when(~usage("completion", 0) | ~usage("prompt", 1), "usage_unknown")
        .when(F.col("prompt") != counted, "tokenizer_mismatch")
        .when(reply > F.col("max_tokens"), "output_budget_violation")
        .when(~F.col("finish").eqNullSafe("stop"), "completion_truncated")
        .when(F.col("action").isNull(), "invalid_action")
        .when(F.col("action") == "final", "answered")
    )
    told = turns.withColumn("_r", reason)
    ends = told.where("_r is not null").groupBy(by).agg(F.min_by(F.struct("turn", "_r"), "turn").alias("_e"))
    kept = told.join(ends, by, "left").where(F.col("_e").isNull() | (F.col("turn") <= F.col("_e.turn")))
    asked = ~F.col("_r").eqNullSafe("input_budget_exhausted")
    known = asked & ~F.coalesce(F.col("_r").isin("model_identity_mismatch", "usage_unknown", "tokenizer_mismatch"), F.lit(False)) & F.col("status").eqNullSafe("response")
    sums = kept.groupBy(by).agg(
        F.first("_e._r").alias("_r"), F.count_if(asked).alias("n_turns"), F.coalesce(F.sum(F.when(asked, counted)), F.lit(0)).alias("counted_input"), F.coalesce(F.sum(F.when(known, reply)), F.lit(0)).alias("completion")
    )
    status = F.coalesce("_r", F.when(F.col("n_turns") >= most, "turn_budget_exhausted").otherwise("open"))
    return sums.select(by, status.alias("status"), "n_turns", "counted_input", "completion")


def shrunk_excerpts(excerpts: DataFrame, fixed: DataFrame, by: str, budget: int) -> DataFrame:
    """``(by, place, text, complete)``: excerpts of a packet, the longest cut first until the packet has ``budget`` characters.

    ``excerpts`` is ``(by, place, text)``; ``fixed (by, chars)`` counts what else the
    packet's JSON holds.  An excerpt loses what is too much and ``SLACK``; one that is
    not longer becomes empty, and the next follows.  Where even empty excerpts
    are too much, the request's ``place`` and text are null.
    """
    order = Window.partitionBy(by).orderBy(F.desc(F.length("text")), "place")
    wire = json_chars(F.col("text"))
    sized = excerpts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_w", wire)
    total = fixed.join(sized.groupBy(by).agg(F.sum("_w").alias("_t")), by, "left").select(by, (F.col("chars") + F.coalesce("_t", F.lit(0)) - budget).alias("_over"))
    # each one before has become empty: what is left of it is its quotes and its mark
    gone = F.coalesce(F.sum(F.col("_w") - 2 - MARK).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sized.join(total, by).withColumn("_over", F.col("_over") - gone)
    cut = F.least(F.length("text"), F.col("_over") + SLACK)
    some = (F.col("_over") > 0) & (F.length("text") > 0)
    kept = told.select(by, "place", F.when(some, F.left("text", F.length("text") - cut)).otherwise(F.col("text")).alias("text"), (~some).alias("complete"), "_over", "_w", cut.alias("_cut"), F.length("text").alias("_n"))
    left = kept.groupBy(by).agg(F.sum(json_chars(F.col("text")) + F.when(F.col("complete"), 0).otherwise(MARK)).alias("_s"))
    fits = fixed.join(left, by, "left").select(by, (F.col("chars") + F.coalesce("_s", F.lit(0)) <= budget).alias("_fits"))
    found = kept.join(fits, by).where("_fits").select(by, "place", "text", "complete")
    none = fits.where("not _fits").select(by, F.lit(None).cast(dict(excerpts.dtypes)["place"]).alias("place"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("complete"))
    return found.unionByName(none)


#: Characters by which ``"complete":true`` grows when it becomes false.  Fixed value.
MARK = 1


def rewrite_consistency(sessions: DataFrame, arm: str, item: str, success: str) -> DataFrame:
    """``(arm, item, n, outcome)``: whether all phrasings of an item succeeded, none, or some."""
    n, ok = F.count("*"), F.count_if(F.coalesce(F.col(success), F.lit(False)))
    each = sessions.groupBy(arm, item).agg(n.alias("n"), ok.alias("_ok"))
    outcome = F.when(F.col("_ok") == F.col("n"), "all_success").when(F.col("_ok") == 0, "all_failure").otherwise("mixed_success")
    return each.select(arm, item, "n", outcome.alias("outcome"))


def citation_only_failures(sessions: DataFrame, success: str, citation: Column, others: list[Column]) -> DataFrame:
    """Sessions that failed although all but their citations is right; what does not apply counts as right."""
    right = F.lit(True)
    for c in others:
        right = right & F.coalesce(c >= 1, F.lit(True))
    return sessions.where(~F.coalesce(F.col(success), F.lit(False)) & F.coalesce(citation < 1, F.lit(False)) & right)


def checked_reviews(sessions: DataFrame, key: str, arm: str, unit: str, reviewed: str) -> DataFrame:
    """``sessions`` as they are; one that is not reviewed, comes twice, or whose unit another arm lacks is an error."""
    arms = sessions.select(arm).distinct().count()
    again = F.count("*").over(Window.partitionBy(arm, key))
    paired = F.size(F.collect_set(arm).over(Window.partitionBy(unit)))
    fault = F.when(~F.coalesce(F.col(reviewed), F.lit(False)), "a session has no completed explicit review").when(again > 1, "a session is duplicate").when(paired < arms, "arms do not have the same questions")
    return sessions.withColumn(key, F.when(fault.isNull(), F.col(key)).otherwise(F.raise_error(fault)))
