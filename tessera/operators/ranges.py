"""Line ranges: expansion, merging, overlap, containment, budgets and delivered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def expand(start: str, end: str, by: int, low: Column, high: Column) -> tuple[Column, Column]:
    """A range widened by ``by`` lines on both sides, within ``low`` and ``high``."""
    return F.greatest(low, F.col(start) - by), F.least(high, F.col(end) + by)


def merge_ranges(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or adjacent ranges: ``(*by, start, end, n)``."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    marked = df.select(*by, F.col(start).alias("start"), F.col(end).alias("end"), new.alias("new"))
    island = marked.withColumn("island", F.sum("new").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], bucket: int = 64) -> DataFrame:
    """Pairs of ranges that share a line: ``a`` has ``a_start, a_end``, ``b`` has ``b_start, b_end``.

    An equi-join on ``on`` and the bucket of lines in which the shared part
    begins, so a path with very many ranges doesn't meet in one product.
    """
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket)))
    left, right = a.withColumn("_k", spread("a_start", "a_end")), b.withColumn("_k", spread("b_start", "b_end"))
    first = F.greatest("a_start", "b_start")
    return (
        left.join(right, [*on, "_k"])
        .where((first <= F.least("a_end", "b_end")) & (F.floor(first / bucket) == F.col("_k")))
        .drop("_k")
    )


def smallest_parent(inner: DataFrame, outer: DataFrame, key: str, path: str, max_chars: int = 1200) -> DataFrame:
    """``inner`` with the shortest range of ``outer (p_start, p_end, p_chars)`` of its path that contains it.

    Ranges meet by buckets of lines, so not all of a path's ranges are paired.
    """
    a = inner.select(key, path, F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = outer.where(F.col("p_chars") <= max_chars).select(path, F.col("p_start").alias("b_start"), F.col("p_end").alias("b_end"))
    inside = (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end"))
    best = F.min(F.struct((F.col("b_end") - F.col("b_start")).alias("len"), "b_start", "b_end")).alias("best")
    found = overlap_join(a, b, [path]).where(inside).groupBy(key).agg(best)
    return inner.join(found, key, "left").select(inner["*"], F.col("best.b_start").alias("p_start"), F.col("best.b_end").alias("p_end"))


def section_ends(headings: DataFrame, path: str, last_line: Column) -> DataFrame:
    """``headings (path, line, level)`` with ``section_end``: the line before the next heading of no deeper level, else the last.

    For each level the nearest later line of it is a running minimum from the end; the least of those that end the section wins.
    """
    after = Window.partitionBy(path).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = F.array(*[F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)])
    return headings.withColumn("section_end", F.coalesce(F.get(nexts, F.col("level") - 1) - 1, last_line))


def deliver_lines(slots: DataFrame, by: str, path: str, order: str = "slot") -> DataFrame:
    """Each line of the ranges once, in the slot that has it first; lines of a slot merged to ranges again."""
    each = slots.select(by, path, order, F.explode(F.sequence("start", "end")).alias("line"))
    first = each.groupBy(by, path, "line").agg(F.min(order).alias(order))
    island = F.col("line") - F.row_number().over(Window.partitionBy(by, path, order).orderBy("line"))
    return first.withColumn("island", island).groupBy(by, order, path, "island").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("island")


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The prefix of each group whose costs sum to ``budget`` at most; adds ``spent``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def undelivered(refs: DataFrame, delivered: DataFrame, by: list[str]) -> DataFrame:
    """Lines of ``refs (by, start, end)`` that no range of ``delivered`` has; none means that all references hold."""
    lines_of = lambda d: d.select(*by, F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return lines_of(refs).join(lines_of(delivered), [*by, "line"], "left_anti")


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, out: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order of all, or of each group ``by``; no task holds more than a range.

    Rows are sorted by ranges and written, ranges are counted (one row each), and
    each range's offset is added to the places within it.  A hot group lies in
    several ranges.
    """
    keys = [*(by or []), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = ranged.join(F.broadcast(before), "_part").withColumn(out, place).drop("_part", "_at", "_before")
    if not by:
        return found
    first = cut(found.groupBy(*by).agg((F.min(out) - 1).alias("_first")), "numbered")
    return found.join(first, by).withColumn(out, F.col(out) - F.col("_first")).drop("_first")
