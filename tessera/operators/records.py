"""Contracts of records, integrity of releases, quality of delivered spans, audits of tools, and splits that fit a size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut

#: Scores that a record may hold.
LEVELS, UNKNOWN, NOT_APPLICABLE = (0.0, 0.25, 0.5, 0.75, 1.0), "unknown", "not_applicable"


def score_issues(records: DataFrame, judges: tuple[str, ...]) -> DataFrame:
    """``records`` with ``issues``: what is wrong with each, in a fixed order; none for a valid one.

    ``records`` has ``sample_id, judge_id, status, points array<struct<criterion_id,score>>,
    fact_gate, applicability_gate`` (scores as texts), ``expected array<string>`` and
    ``conditional`` (null: not known).  A null counts as missing.
    """
    score = lambda c: F.coalesce((c == UNKNOWN) | c.try_cast("double").isin(*LEVELS), F.lit(False))
    ids = F.transform("points", lambda p: p["criterion_id"])
    fits = F.coalesce((F.size(F.array_distinct(ids)) == F.size(ids)) & (F.array_sort(F.array_distinct(ids)) == F.array_sort(F.array_distinct("expected"))), F.lit(False))
    gate = F.col("applicability_gate")
    clash = (F.col("conditional") & (gate == NOT_APPLICABLE)) | (~F.col("conditional") & (gate != NOT_APPLICABLE))
    checks = {
        "judge": ~F.coalesce(F.col("judge_id").isin(*judges), F.lit(False)),
        "status": ~F.coalesce(F.col("status") == "complete", F.lit(False)),
        "identity": F.trim(F.coalesce("sample_id", F.lit(""))) == "",
        "points": F.coalesce(F.size("points"), F.lit(0)) <= 0,
        "point": F.coalesce(F.exists("points", lambda p: ~score(p["score"]) | (F.coalesce(p["criterion_id"], F.lit("")) == "")), F.lit(False)),
        "criteria": ~fits,
        "gates": ~score(F.col("fact_gate")) | ~(score(gate) | F.coalesce(gate == NOT_APPLICABLE, F.lit(False))),
        "conditional": F.coalesce(clash, F.lit(False)),
    }
    return records.withColumn("issues", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()))


def delivery_status(anomaly: Column, complete: Column, conditions: Column, missing: Column) -> Column:
    """State of a delivery by priority: an anomaly, then what is not complete, fails a condition or is missing."""
    whole = F.coalesce(complete & conditions & (missing == 0), F.lit(False))
    return F.when(anomaly, F.lit("model_anomaly_stop")).when(~whole, F.lit("development_incomplete")).otherwise(F.lit("development_evidence_collected"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """``(check, n)``: rows that break each rule of a release; all must be 0."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def span_quality(delivered: DataFrame, gold: DataFrame, by: str, path: str = "path") -> DataFrame:
    """Of each query with gold ranges: ``n_gold, path_recall, span_recall, reciprocal_rank, duplicate_fraction``.

    ``delivered`` is ``(by, path, start, end, rank)``, ``gold`` ``(by, path, start, end)``, equal
    ranges once.  A gold range counts if all its lines were delivered; the rank is
    that of the first range with a gold line; duplicates are lines delivered again.
    """
    lines = lambda d, *more: d.select(by, path, *more, F.explode(F.sequence("start", "end")).alias("line"))
    given = lines(delivered, "rank").groupBy(by, path, "line").agg(F.min("rank").alias("rank"), F.count("*").alias("_n"))
    wanted = gold.select(by, path, "start", "end").distinct()
    met = lines(wanted, "start", "end").join(given, [by, path, "line"], "left")
    spans = met.groupBy(by, path, "start", "end").agg(F.every(F.col("rank").isNotNull()).alias("_whole"), F.min("rank").alias("_first"))
    paths = delivered.select(by, path).distinct().withColumn("_p", F.lit(True))
    each = spans.join(paths, [by, path], "left").groupBy(by).agg(
        F.count("*").alias("n_gold"), F.round(F.avg(F.coalesce("_p", F.lit(False)).cast("int")), 6).alias("path_recall"), F.round(F.avg(F.col("_whole").cast("int")), 6).alias("span_recall"), F.round(F.coalesce(1 / F.min("_first"), F.lit(0.0)), 6).alias("reciprocal_rank")
    )
    again = given.groupBy(by).agg(F.round(F.sum(F.col("_n") - 1) / F.sum("_n"), 6).alias("duplicate_fraction"))
    return each.join(again, by, "left").withColumn("duplicate_fraction", F.coalesce("duplicate_fraction", F.lit(0.0)))


def macro(scores: DataFrame, arm: str, category: str, value: str) -> DataFrame:
    """Of each arm: its categories, the mean of all values and the mean of the categories' means."""
    each = scores.groupBy(arm, category).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return each.where("_n > 0").groupBy(arm).agg(F.count("*").alias("n_categories"), F.round(F.sum("_s") / F.sum("_n"), 6).alias("micro"), F.round(F.avg(F.col("_s") / F.col("_n")), 6).alias("macro"))


def tool_text(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``(tool, n_results, characters, errors)``: what tools returned; results without a call count for ``unknown``.

    ``calls`` is ``(session, call, tool)``, each call once, ``results`` ``(session, call, text, error)``.
    """
    named = results.join(calls.select("session", "call", "tool"), ["session", "call"], "left").withColumn("tool", F.coalesce("tool", F.lit("unknown")))
    return named.groupBy("tool").agg(F.count("*").alias("n_results"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"))


def longest_prefix(lines: DataFrame, by: str, budget: int) -> DataFrame:
    """``(by, end, chars, next_line)``: the most first lines of ``(by, line, text)`` that have ``budget`` characters, breaks included.

    ``end`` is 0 where not even the first line fits; ``next_line`` is null once all is read.
    """
    spent = F.sum(F.length("text") + 1).over(Window.partitionBy(by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("_s") <= budget
    found = lines.select(by, "line", spent.alias("_s")).groupBy(by).agg(F.coalesce(F.max(F.when(fits, F.col("line"))), F.lit(0)).alias("end"), F.coalesce(F.max(F.when(fits, F.col("_s"))), F.lit(0)).alias("chars"), F.max("line").alias("_last"))
    return found.select(by, "end", "chars", F.when(F.col("end") < F.col("_last"), F.col("end") + 1).alias("next_line"))


def mentioned(requests: DataFrame, names: DataFrame, request: str, name: str = "name") -> DataFrame:
    """``(request, name, n_names)``: the name that stands in a request's ``text`` between identifier boundaries; null unless it is the only one.

    Requests and names meet on the names' first terms, then each pair is confirmed.
    """
    first = names.select(name).distinct().withColumn("_t", F.get(F.regexp_extract_all(F.lower(name), F.lit("[a-z_][a-z_0-9]*|[0-9]+"), F.lit(0)), F.lit(0)))
    bare = F.lower(F.coalesce("text", F.lit("")))
    near = requests.select(request, "text", F.explode(T.terms(F.col("text"))).alias("_t")).join(first, "_t")
    pattern = F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.lower(name), F.lit(r"\E(?![a-z0-9_])"))
    found = near.where(F.regexp_like(bare, pattern)).select(request, name).distinct().groupBy(request).agg(F.min(name).alias("_m"), F.count("*").alias("_n"))
    return requests.select(request).join(found, request, "left").select(request, F.when(F.col("_n") == 1, F.col("_m")).alias(name), F.coalesce("_n", F.lit(0)).alias("n_names"))


def fitted(units: DataFrame, size, limit: int, keep: tuple[str, ...] = (), max_rounds: int = 40) -> DataFrame:
    """Units of lines halved until each has a ``size`` (a function of a text column) of ``limit`` or one line: ``(*keep, start, end, text, size, over)``.

    ``units`` is ``(*keep, start, end, text)`` with a line for each number from start to end;
    halves are of equally many lines, the first the longer.  Each round halves
    what is still too large, so rounds grow with the logarithm of the lines.
    """
    rows, done = units.select(*keep, "start", "end", "text"), []
    for _ in range(max_rounds):
        sized = cut(rows.withColumn("size", size(F.col("text"))))
        fits = (F.col("size") <= limit) | (F.col("start") >= F.col("end"))
        done.append(sized.where(fits).withColumn("over", F.col("size") > limit))
        large = sized.where(~fits)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        mid = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
        part = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
        halves = large.withColumns({"_l": F.split("text", "\n", -1), "_o": F.col("start")}).withColumn("_h", F.explode(F.array(part(F.col("start").cast("int"), mid), part(mid + 1, F.col("end").cast("int")))))
        joined = F.array_join(F.slice("_l", (F.col("_h.s") - F.col("_o") + 1).cast("int"), F.col("_h.e") - F.col("_h.s") + 1), "\n")
        rows = halves.select(*keep, F.col("_h.s").alias("start"), F.col("_h.e").alias("end"), joined.alias("text"))
    raise RuntimeError(f"units are still too large after {max_rounds} rounds")


def alternatives(text: Column) -> Column:
    """``a(b|c)d`` as ``[abd, acd]``: the first group of alternatives written out; a text without one stands alone, a null has none."""
    group = r"(?s)^(.*?)\(([^()|]*(?:\|[^()|]*)+)\)(.*)$"
    head, inner, tail = (F.regexp_extract(text, group, k) for k in (1, 2, 3))
    return F.when(inner == "", F.array(text)).otherwise(F.transform(F.split(inner, r"\|", -1), lambda x: F.concat(head, x, tail)))
