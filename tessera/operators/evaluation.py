"""Scores with unknowns, agreement, comparison, bootstrap, sampling, panels and grading."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators.ranges import numbered

#: Outcomes that say nothing about the answer.  Fixed values.
NOT_RUN = ("not_run", "started", "in_flight", "outcome_unknown", "http_result_unknown", "usage_unknown", "runner_error", "deployment_halted", "not_dispatched_model_halted")


def agreement(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """One row: ``n, exact, mae, bias, max_difference, quadratic_kappa`` of two raters of five levels.

    The expected disagreement of independent raters is a function of the two
    means and mean squares, so one pass suffices; kappa is null where it is 0.
    Pairs with a null are counted as ``unknown_pairs`` only.
    """
    x, y = F.col(left).cast("double"), F.col(right).cast("double")
    known = x.isNotNull() & y.isNotNull()
    d, x, y = F.when(known, y - x), F.when(known, x), F.when(known, y)
    expected = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return pairs.agg(
        F.count_if(known).alias("n"),
        F.count_if(~known).alias("unknown_pairs"),
        F.round(F.avg((d == 0).cast("double")), 6).alias("exact"),
        F.round(F.avg(F.abs(d)), 6).alias("mae"),
        F.round(F.avg(d), 6).alias("bias"),
        F.max(F.abs(d)).alias("max_difference"),
        F.round(F.when(F.abs(expected) > 1e-12, 1 - F.avg(d * d) / expected), 6).alias("quadratic_kappa"),
    )


def confusion(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    return pairs.where(f"{left} is not null and {right} is not null").groupBy(left, right).agg(F.count("*").alias("n"))


def comparison(pairs: DataFrame, by: str, left: str = "left", right: str = "right", high: float = 100.0) -> DataFrame:
    """Errors of each group; rates on the known pairs and on all, and bounds of the mean error with unknowns at worst and best."""
    d = F.col(right) - F.col(left)
    known = d.isNotNull()
    one = F.coalesce(left, right)
    worst = F.when(known, F.abs(d)).when(one.isNull(), high).otherwise(F.greatest(one, high - one))
    return pairs.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(known).alias("identified"),
        F.round(F.avg(F.abs(d)), 6).alias("mae"),
        F.round(F.avg(d), 6).alias("bias"),
        F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"),
        F.round(F.count_if(F.abs(d) <= 0.25 * high) / F.nullif(F.count_if(known), F.lit(0)), 6).alias("within_identified"),
        F.round(F.count_if(F.abs(d) <= 0.25 * high) / F.count("*"), 6).alias("within_all"),
        F.round(F.sum(F.when(known, F.abs(d)).otherwise(0.0)) / F.count("*"), 6).alias("mae_low"),
        F.round(F.sum(worst) / F.count("*"), 6).alias("mae_high"),
    )


def composite(df: DataFrame, points: str = "points", f: str = "f", a: str = "a", conditional: str = "conditional", failed: str = "failed") -> DataFrame:
    """``df`` with arithmetic and geometric composites of 0 to 100, strict passes, and bounds where scores are null.

    ``points`` is an array of scores, the others one score each; a null score
    is unknown and lies anywhere from 0 to 1.  ``a`` counts where
    ``conditional`` holds.  Failed rows score 0.
    """
    bound = lambda c, side: F.coalesce(c, F.lit(float(side)))

    def sides(side: int) -> tuple[Column, Column, Column]:
        k = F.aggregate(points, F.lit(0.0), lambda s, x: s + bound(x, side)) / F.size(points)
        ff, aa = bound(F.col(f), side), bound(F.col(a), side)
        mean = F.when(F.col(conditional), (k + ff + aa) / 3).otherwise((k + ff) / 2)
        geo = F.when(F.col(conditional), F.pow(k * ff * aa, F.lit(1 / 3))).otherwise(F.sqrt(k * ff))
        strict = F.forall(points, lambda x: bound(x, side) == 1) & (ff == 1) & (~F.col(conditional) | (aa == 1))
        dead = F.col(failed)
        return tuple(F.when(dead, 0.0).otherwise(F.round(v, 6)) for v in (100 * mean, 100 * geo, strict.cast("double")))

    low, high = sides(0), sides(1)
    unknown = F.exists(points, lambda x: x.isNull()) | F.col(f).isNull() | (F.col(conditional) & F.col(a).isNull())
    exact = lambda c: F.when(~unknown | F.col(failed), c)
    return df.withColumns(
        {
            "arith": exact(low[0]),
            "geo": exact(low[1]),
            "strict": F.when(low[2] == high[2], low[2]),
            "arith_low": low[0],
            "arith_high": high[0],
            "geo_low": low[1],
            "geo_high": high[1],
        }
    )


def two_judges(scores: DataFrame, by: str, judge: str, value: str) -> DataFrame:
    """Mean of exactly two judges' values of each item; null if either is, left out with any other number of judges."""
    g = scores.groupBy(by).agg(F.countDistinct(judge).alias("judges"), F.count("*").alias("rows"), F.count(value).alias("known"), F.avg(value).alias("mean"))
    return g.where("judges = 2 and rows = 2").select(by, F.when(F.col("known") == 2, F.round("mean", 6)).alias("mean"))


def resamples(spark: SparkSession, clusters: int, n: int = 2000, seed: int = 20261021) -> DataFrame:
    """``(resample, cluster, times)``: how often each of ``clusters`` clusters is drawn, from the standard generator.

    Drawn in tasks of one hundred resamples, each from a seed of its own.
    """

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for block in batch.column(0).to_pylist():
                rng = random.Random(seed + block)
                out = []
                for r in range(block * 100, min(n, block * 100 + 100)):
                    times = [0] * clusters
                    for k in rng.choices(range(clusters), k=clusters):
                        times[k] += 1
                    out += [(r, k, t) for k, t in enumerate(times) if t]
                yield pa.RecordBatch.from_pydict({"resample": [x[0] for x in out], "cluster": [x[1] for x in out], "times": [x[2] for x in out]})

    return spark.range(-(-n // 100)).mapInArrow(draw, "resample long, cluster long, times long")


def cluster_bootstrap(values: DataFrame, by: str, value: str, draws: DataFrame) -> DataFrame:
    """One row: intervals of mean absolute value and mean under resampling of whole clusters.

    A resample needs each cluster's sums only.  Clusters are numbered by name;
    the interval's ends are the values at floor(p (n - 1)) in order.
    """
    sums = values.groupBy(by).agg(F.sum(F.abs(value)).alias("a"), F.sum(value).alias("s"), F.count(value).alias("n"))
    placed = numbered(sums, [by], out="cluster").withColumn("cluster", F.col("cluster") - 1)
    each = draws.join(placed, "cluster").groupBy("resample").agg(
        F.round(F.sum(F.col("times") * F.col("a")) / F.sum(F.col("times") * F.col("n")), 9).alias("mae"), F.round(F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n")), 9).alias("bias")
    )
    at = lambda c, p: F.get(F.sort_array(F.collect_list(c)), F.floor(p * (F.count("*") - 1)).cast("int"))
    return each.agg(at("mae", 0.025).alias("mae_low"), at("mae", 0.975).alias("mae_high"), at("bias", 0.025).alias("bias_low"), at("bias", 0.975).alias("bias_high"), F.count("*").alias("resamples"))


def hash_order(seed: str, *columns: Column) -> Column:
    """A sort key that shuffles rows the same way each time."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in columns]), 256)


def stratified(df: DataFrame, stratum: str, id: str, per_stratum: int, seed: str) -> DataFrame:
    """The first ``per_stratum`` rows of each stratum by ``hash_order``; adds ``place``."""
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(id)), id)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_stratum)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms of characters to their plain ones."""
    return texts.str.normalize("NFKC")


def grade(df: DataFrame, kind: str = "kind", answer: str = "answer", status: str = "status", gold: str = "gold") -> DataFrame:
    """Grades of answers with one ``FINAL:`` marker, in their last line.

    ``single`` is one of A to D, ``judge`` true or false in some spelling,
    ``numeric`` within the greater of ``absolute_tolerance`` and
    ``relative_tolerance`` times the gold value (columns of ``df``; 0 where
    absent or null), ``fill`` the text itself or one of ``aliases`` (an array, or
    absent).  Values are compared in their NFKC form without back quotes around them.
    Outcomes that are not known give a null score with bounds 0 and 1.  Adds
    ``value, format_valid, score, score_low, score_high, reason``.
    """
    column = lambda name, other: F.coalesce(F.col(name), other) if name in df.columns else other
    plain = lambda c: F.trim(F.btrim(F.trim(nfkc(c)), F.lit("`")))
    held = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r?\n", -1), F.trim), lambda x: x != "")
    marked = F.filter(held, lambda x: x.startswith("FINAL:"))
    one = (F.size(marked) == 1) & F.coalesce(F.element_at(F.reverse(held), 1).startswith("FINAL:"), F.lit(False))
    value = F.when(one, plain(F.substring(F.get(marked, F.lit(0)), 7, 1_000_000)))
    truth = lambda c: F.when(c.isin("true", "正确", "是", "对"), True).when(c.isin("false", "错误", "否", "错"), False)
    v, g = F.col("value"), F.col(gold)
    valid = (
        F.when(F.col(kind) == "single", v.rlike("^[ABCD]$"))
        .when(F.col(kind) == "judge", truth(v).isNotNull())
        .when(F.col(kind) == "numeric", v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
        .otherwise(v.rlike(r"^[-\p{L}\p{N}_.<>]+$"))
    )
    target = g.try_cast("double")
    within = F.greatest(column("absolute_tolerance", F.lit(0.0)), F.abs(target) * column("relative_tolerance", F.lit(0.0)))
    # aliases are joined for one call: a line break can be in no valid value
    named = F.split(plain(F.array_join(F.concat(F.array(g), column("aliases", F.array().cast("array<string>"))), "\n")), "\n")
    right = (
        F.when(F.col(kind) == "judge", truth(v) == truth(g))
        .when(F.col(kind) == "numeric", F.abs(v.try_cast("double") - target) <= within)
        .when(F.col(kind) == "single", v == g)
        .otherwise(F.array_contains(F.transform(named, lambda x: F.trim(F.btrim(F.trim(x), F.lit("`")))), v))
    )
    unknown = F.col(status).isNull() | F.col(status).isin(*NOT_RUN)
    answered = F.coalesce(F.col(status) == "answered", F.lit(False))
    out = df.withColumn("value", F.when(answered, value)).withColumn("format_valid", answered & F.coalesce(valid, F.lit(False)))
    score = F.when(unknown, None).otherwise((F.col("format_valid") & F.coalesce(right, F.lit(False))).cast("int"))
    return out.withColumn("score", score).withColumns(
        {
            "score_low": F.coalesce("score", F.lit(0)),
            "score_high": F.coalesce("score", F.lit(1)),
            "reason": F.when(unknown, "not_run_or_outcome_unknown")
            .when(~answered, "generation_failed")
            .when(v.isNull(), "missing_or_multiple_final_marker")
            .when(v == "", "empty_final")
            .when(F.col("score") == 1, "correct")
            .when(F.col("format_valid"), "wrong_answer")
            .otherwise("invalid_final_format"),
        }
    )


def unique_match(left: DataFrame, right: DataFrame, on: list[str], id: str) -> DataFrame:
    """``left`` joined with the one row of ``right`` that has its key; keys that several rows have match nothing."""
    only = right.groupBy(*on).agg(F.count("*").alias("_n"), F.min(id).alias(id)).where("_n = 1").drop("_n")
    return left.join(only, on)
