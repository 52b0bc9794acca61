"""Filters by what is known of rows, comparisons of sets, and orders by several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with the named columns only; one that is missing is an error."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*fields)


def unseen(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among those seen before."""
    return rows.join(seen.select(*on), on, "left_anti")


def in_scope(path: Column, scopes: Column, root: str = "") -> Column:
    """Whether ``path`` lies below one of ``scopes`` (an array); no scopes, or a path outside of ``root``, are no restriction."""
    below = F.exists(scopes, lambda s: F.startswith(path, F.concat(F.rtrim(s, F.lit("/")), F.lit("/"))))
    return F.coalesce(F.size(scopes) <= 0, F.lit(True)) | ~F.startswith(path, F.lit(root)) | F.coalesce(below, F.lit(False))


def chosen(rows: DataFrame, ids: DataFrame, id: str, place: str, limit: int) -> DataFrame:
    """The first ``limit`` wanted ids ``(id, place)`` with their rows, in the wanted order; an id without a row is an error."""
    first = ids.orderBy(place).limit(limit)
    unknown = [r[0] for r in first.join(rows.select(id), id, "left_anti").select(id).limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown ids: {unknown}")
    return rows.join(F.broadcast(first), id)  # limit rows


def boilerplate(text: Column, header: str = "FoamFile", contents: str = r"(?i)(?:table of )?contents|目录") -> Column:
    """Whether a text is a file header or only a heading of contents."""
    return F.coalesce(F.startswith(text, F.lit(header)) | F.trim(text).rlike(rf"\A(?:{contents})\z"), F.lit(False))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(only_left, only_right, both, same, disjoint)`` of two sets of rows with the same columns."""
    sides = a.distinct().withColumn("_l", F.lit(1)).unionByName(b.distinct().withColumn("_l", F.lit(2)))
    each = sides.groupBy(*a.columns).agg(F.sum("_l").alias("_l"))
    counts = each.agg(*[F.count_if(F.col("_l") == k).alias(n) for k, n in ((1, "only_left"), (2, "only_right"), (3, "both"))])
    return counts.withColumns({"same": (F.col("only_left") == 0) & (F.col("only_right") == 0), "disjoint": F.col("both") == 0})


def balance(panels: DataFrame, panel: str, cell: list[str], per_cell: int = 1) -> DataFrame:
    """Of each panel its rows, cells, and the cells that more than ``per_cell`` rows share."""
    each = panels.groupBy(panel, *cell).agg(F.count("*").alias("n"))
    return each.groupBy(panel).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_cells"), F.count_if(F.col("n") > per_cell).alias("n_crowded"))


def higher(a: DataFrame, b: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Rows of both rankings; a key that both have keeps its higher score."""
    return a.select(*keys, score).unionByName(b.select(*keys, score)).groupBy(*keys).agg(F.max(score).alias(score))


def placed(rows: DataFrame, by: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in each group, by several keys."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def checked(df: DataFrame, checks: dict[str, Column], required: list[str] | None = None) -> DataFrame:
    """``df`` with ``checks map<string,boolean>``, ``issues`` (names of those that don't hold, in order) and ``passed``.

    A check that is null doesn't hold.  ``required`` names the checks that decide; all by default.
    """
    held = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    issues = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in held.items()]), lambda x: x.isNotNull())
    deciding = F.array(*map(F.lit, required if required is not None else held)).cast("array<string>")
    out = df.withColumns({"checks": F.create_map(*[x for n, c in held.items() for x in (F.lit(n), c)]), "issues": issues})
    return out.withColumn("passed", ~F.arrays_overlap("issues", deciding))


def conditions(df: DataFrame, wanted: str, context: str) -> DataFrame:
    """``df`` with ``truth`` and ``missing``: conditions ``array<struct<field,value>>`` against a map of what is known.

    False as soon as a known field has another value, else null (unknown) while
    fields are missing, which ``missing`` names, else true.
    """
    missing = F.transform(F.filter(wanted, lambda c: F.get(F.array(F.element_at(context, c["field"])), F.lit(0)).isNull()), lambda c: c["field"])
    wrong = F.exists(wanted, lambda c: F.coalesce(F.element_at(context, c["field"]) != c["value"], F.lit(False)))
    return df.withColumn("missing", missing).withColumn("truth", F.when(wrong, F.lit(False)).when(F.size("missing") == 0, F.lit(True)))


def inventory(files: DataFrame, by: str, path: str = "path", cap: int = 80) -> DataFrame:
    """The first ``cap`` files of each case by path, and whether that many were found."""
    n = F.count("*").over(Window.partitionBy(by))
    return placed(files.withColumn("truncated", n >= cap), [by], [F.asc(path)]).where(F.col("place") <= cap)


def tier_stop(tiers: DataFrame, order: str, rate: str, gain: float = 0.03, misses: int = 2) -> DataFrame:
    """Tiers up to where probing stops: after ``misses`` in a row that don't exceed the best before by ``gain``.  Few rows: one a tier."""
    w = Window.orderBy(order)
    before = F.max(rate).over(w.rowsBetween(Window.unboundedPreceding, -1))
    missed = tiers.withColumn("better", before.isNull() | (F.col(rate) > before * (1 + gain)))
    late = F.sum((~F.col("better")).cast("int")).over(w.rowsBetween(1 - misses, 0)) == misses
    stops = missed.withColumn("_s", late).withColumn("stopped", F.coalesce(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return stops.where(~F.col("stopped")).drop("_s", "stopped")


def without_sensitive_files(lines: DataFrame, by: str, sensitive, line: str = "line", text: str = "text") -> DataFrame:
    """Lines of diffs but for those of files whose header names a path that ``sensitive`` (a function of a column) holds of."""
    parts = F.split(F.trim(text), r"\s+")
    header = F.startswith(F.col(text), F.lit("diff --git ")) & (F.size(parts) >= 4)
    hidden = F.when(F.startswith(F.col(text), F.lit("diff --git ")), header & (sensitive(F.get(parts, F.lit(2))) | sensitive(F.get(parts, F.lit(3)))))
    last = F.last(hidden, ignorenulls=True).over(Window.partitionBy(by).orderBy(line))
    return lines.withColumn("_h", F.coalesce(last, F.lit(False))).where(~F.col("_h")).drop("_h")
