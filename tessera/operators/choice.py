"""Choice of evidence after ranking: groups under a cap, exact bundles, context of fragments.

What a request takes depends on what it has taken before.  Such choices run in
rounds over all requests: from running totals follows the longest prefix that
fits, what no longer can fit goes, and the rest waits for the next round.  So
no request has to lie in one row or task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import numbered
from tessera.session import cut

#: Places of a request that one task adds up.
BLOCK = 4_096
#: Rounds after which what is still open is decided in one ordered pass.
ROUNDS = 12


def running_total(df: DataFrame, by: list[str], place: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each ``place`` (a whole number, once in its group).

    Sums of blocks of places are added up first, so a hot group is split.
    """
    blocked = df.withColumn("_b", F.floor(F.col(place) / BLOCK))
    sums = blocked.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return blocked.withColumn("_in", within).join(sums, [*by, "_b"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def greedy_under_cap(groups: DataFrame, by: list[str], place: str, cost: str, cap: Column | int, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``groups`` that are taken in the order of ``place`` while they fit ``cap``; those that don't fit are passed over.

    ``place`` is a whole number, once in each group ``by``; costs are at least 0,
    and a row without a cost is not taken.  In each round the first row that does
    not fit is larger than what is left, so it goes with all others that are.
    """
    names = groups.columns
    left = cap if isinstance(cap, Column) else F.lit(cap)
    waiting = cut(groups.withColumn("_left", left.cast("long")).where(F.col(cost) <= F.col("_left")), "greedy")
    taken = [waiting.limit(0).select(*names)]
    for _ in range(rounds):
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        tried = cut(running_total(waiting, by, place, cost, "_spent").withColumn("_fits", F.col("_spent") <= F.col("_left")), "greedy")
        taken.append(tried.where("_fits").select(*names))
        spent = tried.where("_fits").groupBy(*by).agg(F.max("_spent").alias("_used"))
        rest = tried.where("not _fits").join(spent, by).withColumn("_left", F.col("_left") - F.col("_used"))
        waiting = cut(rest.where(F.col(cost) <= F.col("_left")).drop("_spent", "_fits", "_used"), "greedy")
    return reduce(DataFrame.unionByName, [*taken, _one_pass(waiting, by, place, cost).select(*names)])


def _one_pass(waiting: DataFrame, by: list[str], place: str, cost: str) -> DataFrame:
    """The same by one ordered pass that keeps a number for the present request only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, left = None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            keep = []
            for key, size, start in zip(keys, batch.column(cost).to_pylist(), batch.column("_left").to_pylist()):
                if key != present:
                    present, left = key, start
                keep.append(size <= left)
                left -= size if keep[-1] else 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return waiting.repartition(*by).sortWithinPartitions(*by, place).mapInArrow(scan, waiting.schema)


def by_files(ranked: DataFrame, by: str) -> DataFrame:
    """``ranked (by, place, path, start, end)`` renumbered so that a path's ranges follow its best one, in the order of lines."""
    best = ranked.groupBy(by, "path").agg(F.min("place").alias("_best"))
    return numbered(ranked.join(best, [by, "path"]).drop("place"), ["_best", "start", "end"], [by]).drop("_best")


def with_links(ranked: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """``ranked`` followed by what ``links (path, start, end, to_path, to_start, to_end)`` lead to from it.

    What is linked comes after all that was ranked, in the order of the best
    range that leads there, so it never displaces a match.
    """
    ends = [F.col("to_path").alias("path"), F.col("to_start").alias("start"), F.col("to_end").alias("end")]
    led = ranked.join(links, ["path", "start", "end"]).groupBy(by, *ends).agg(F.min("place").alias("place"))
    led = led.join(ranked.select(by, "path", "start", "end"), [by, "path", "start", "end"], "left_anti")
    every = ranked.select(by, "place", "path", "start", "end", F.lit(0).alias("_far")).unionByName(led.select(by, "place", "path", "start", "end", F.lit(1).alias("_far")))
    return numbered(every.withColumnRenamed("place", "_at"), ["_far", "_at", "path", "start", "end"], [by]).drop("_far", "_at")


def bundle(ranked: DataFrame, lines: DataFrame, by: str, budget: int) -> DataFrame:
    """``(by, place, path, start, end, text)``: exact source text of ranked ranges, no line twice, under a budget of characters.

    Ranges ``(by, place, path, start, end)`` are taken in order; one that has
    lines which were delivered before is cut to its other lines, and may so fall
    into several pieces; one whose other lines don't fit is passed over.  A
    line of ``lines (path, line, text)`` counts its characters and one for its end.

    A round gives each line to the first open range that has it.  Costs so told
    hold for the prefix that fits, as all before is taken; they are the least
    possible ones for all others, so what exceeds the rest of the budget goes.
    """
    sized = lines.select("path", "line", "text", (F.length("text") + 1).cast("long").alias("_c"))
    each = ranked.select(by, "place", "path", F.explode(F.sequence("start", "end")).alias("line"))
    waiting = cut(each.join(sized.select("path", "line", "_c"), ["path", "line"]).withColumn("_left", F.lit(budget).cast("long")), "bundle")
    taken: list[DataFrame] = [waiting.limit(0).select(by, "place", "path", "line")]
    while not waiting.isEmpty():
        owned = cut(waiting.groupBy(by, "path", "line").agg(F.min("place").alias("place"), F.first("_c").alias("_c"), F.first("_left").alias("_left")), "bundle")
        costs = owned.groupBy(by, "place").agg(F.sum("_c").alias("_cost"), F.first("_left").alias("_left"))
        tried = cut(running_total(costs, [by], "place", "_cost", "_spent").withColumn("_fits", F.col("_spent") <= F.col("_left")), "bundle")
        fits = tried.where("_fits").select(by, "place")
        got = cut(owned.join(fits, [by, "place"]).select(by, "place", "path", "line"), "bundle")
        taken.append(got)
        spent = tried.where("_fits").groupBy(by).agg(F.max("_spent").alias("_used"))
        told = tried.join(spent, by, "left").withColumn("_rest", F.col("_left") - F.coalesce("_used", F.lit(0)))
        # a place whose lines all wait for earlier open places is not decided yet
        decided = told.where(F.col("_fits") | (F.col("_cost") > F.col("_rest"))).select(by, "place")
        waiting = waiting.join(decided, [by, "place"], "left_anti").join(got.select(by, "path", "line"), [by, "path", "line"], "left_anti").join(spent, by, "left")
        waiting = cut(waiting.select(by, "place", "path", "line", "_c", (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left")), "bundle")
    every = reduce(DataFrame.unionByName, taken)
    island = F.col("line") - F.row_number().over(Window.partitionBy(by, "place", "path").orderBy("line"))
    pieces = every.withColumn("_i", island).join(sized.select("path", "line", "text"), ["path", "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return pieces.groupBy(by, "place", "path", "_i").agg(F.min("line").alias("start"), F.max("line").alias("end"), text.alias("text")).drop("_i")


def placed_units(units: DataFrame) -> DataFrame:
    """``units (path, at, chars, ..)`` with ``_up``, the characters before each in its path."""
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("_up", F.coalesce(F.sum("chars").over(before), F.lit(0)))


def _grown(began: DataFrame, placed: DataFrame, by: list[str], budget: int) -> DataFrame:
    """``(*by, path, unit, at, nearness)``: what ``began (*by, path, _first, _last, _used, _right_first)`` grows by on both sides in turn.

    Units are met by the bucket of the characters before them, so only those
    that the budget can reach are, and what a row holds is bounded by it.
    """
    ends = placed.select("path", F.col("at").alias("_first"), F.col("_up").alias("_low")), placed.select("path", F.col("at").alias("_last"), (F.col("_up") + F.col("chars")).alias("_high"))
    low, high = F.floor(F.col("_low") / budget), F.floor(F.col("_high") / budget)
    near = began.join(ends[0], ["path", "_first"]).join(ends[1], ["path", "_last"])
    near = near.withColumn("_k", F.explode(F.array_distinct(F.array(low - 1, low, high, high + 1))))
    beside = near.join(placed.select("path", "at", "unit", "chars", "barrier", F.floor(F.col("_up") / budget).alias("_k")), ["path", "_k"]).where("at < _first or at > _last")
    right = F.col("at") > F.col("_last")
    steps = F.when(right, F.col("at") - F.col("_last")).otherwise(F.col("_first") - F.col("at"))
    order = F.struct(steps.alias("step"), (right != F.col("_right_first")).alias("later"), right.alias("right"), "at", "unit", "chars", "barrier")
    tried = beside.groupBy(*by, "path", "_used").agg(F.array_sort(F.collect_list(order)).alias("_c"))
    kinds = dict(tried.dtypes)["_c"]

    def grow(s: Column, x: Column) -> Column:
        live = F.when(x["right"], s["right"]).otherwise(s["left"]) & ~x["barrier"] & (s["used"] + x["chars"] <= budget)
        return F.struct(
            F.when(live, s["used"] + x["chars"]).otherwise(s["used"]).alias("used"),
            F.when(x["right"], s["left"]).otherwise(live).alias("left"),
            F.when(x["right"], live).otherwise(s["right"]).alias("right"),
            F.when(live, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"),
        )

    start = F.struct(F.col("_used").cast("long").alias("used"), F.lit(True).alias("left"), F.lit(True).alias("right"), F.array().cast(kinds).alias("taken"))
    grown = tried.select(*by, "path", F.explode(F.aggregate("_c", start, grow, lambda s: s["taken"])).alias("_t"))
    return grown.select(*by, "path", F.col("_t.unit").alias("unit"), F.col("_t.at").alias("at"), F.col("_t.step").alias("nearness"))


def grow_lines(anchors: DataFrame, lines: DataFrame, by: list[str], budget: int = 1_200) -> DataFrame:
    """``anchors (*by, path, start, end)`` with ``left`` and ``right``: widened by a line on each side in turn while the added lines, each with its end, fit ``budget``."""
    placed = cut(placed_units(lines.select("path", F.col("line").alias("at"), F.col("line").alias("unit"), (F.length("text") + 1).cast("long").alias("chars"), F.lit(False).alias("barrier"))), "lines")
    began = anchors.select(*by, "path", F.col("start").alias("_first"), F.col("end").alias("_last"), F.lit(0).alias("_used"), F.lit(False).alias("_right_first"))
    wide = _grown(began, placed, by, budget).groupBy(*by).agg(F.min("at").alias("_l"), F.max("at").alias("_r"))
    return anchors.join(wide, by, "left").withColumns({"left": F.least("start", F.coalesce("_l", "start")), "right": F.greatest("end", F.coalesce("_r", "end"))}).drop("_l", "_r")


def grow_context(seeds: DataFrame, units: DataFrame, containers: DataFrame, by: str, budget: int, ratio: float = 0.5, hit_limit: int = 64) -> DataFrame:
    """``(by, rank, seed, unit, path, at, nearness)``: the fragments that each ranked seed brings along, each once for a request.

    ``units (unit, path, at, chars, barrier)`` are fragments, numbered without gaps
    in their path; ``containers (container, path, first, last)`` are runs of them;
    ``seeds (by, rank, unit)`` are ranked hits.  A seed takes the shortest container
    around it of more than one fragment that fits ``budget`` and of which more than
    ``ratio`` are among the request's first ``hit_limit`` hits.  From there it grows
    to the fragments next to what it has, one on each side in turn and as far as the
    budget goes; a side ends at a fragment that doesn't fit or is a barrier.  A
    fragment belongs to the first seed of its request that takes it.
    """
    placed = cut(placed_units(units), "units")
    at = placed.select("unit", "path", "at", "chars", "_up")
    whole = containers.join(at.select("path", F.col("at").alias("first"), F.col("_up").alias("_from")), ["path", "first"])
    whole = whole.join(at.select("path", F.col("at").alias("last"), (F.col("_up") + F.col("chars")).alias("_to")), ["path", "last"])
    whole = whole.withColumns({"_n": F.col("last") - F.col("first") + 1, "_chars": F.col("_to") - F.col("_from")}).where((F.col("_n") > 1) & (F.col("_chars") <= budget))
    member = whole.select("container", "path", "first", "last", "_n", "_chars", F.explode(F.sequence("first", "last")).alias("at")).join(placed.select("path", "at", "unit"), ["path", "at"])
    hits = seeds.where(F.col("rank") <= hit_limit).select(by, "unit").distinct().join(member.select("unit", "container", "_n"), "unit")
    dense = hits.groupBy(by, "container", "_n").agg(F.count("*").alias("_h")).where(F.col("_h") / F.col("_n") > ratio).select(by, "container")
    around = seeds.join(member.select("unit", "container", "first", "last", "_chars"), "unit").join(dense, [by, "container"])
    chosen = around.groupBy(by, "rank", "unit").agg(F.min(F.struct("_chars", "first", "last")).alias("_p"))
    began = seeds.join(chosen, [by, "rank", "unit"], "left").join(at, "unit")
    first, last = F.coalesce("_p.first", "at"), F.coalesce("_p.last", "at")
    began = began.select(by, "rank", F.col("unit").alias("seed"), "path", F.col("at").alias("_own"), first.alias("_first"), last.alias("_last"), F.coalesce("_p._chars", "chars").alias("_used"))
    # the end at which the seed itself lies is tried first, else the left one
    right_first = (F.col("_own") == F.col("_last")) & (F.col("_own") != F.col("_first"))
    grown = _grown(began.withColumn("_right_first", right_first), placed, [by, "rank", "seed"], budget)
    core = began.select(by, "rank", "seed", "path", F.explode(F.sequence("_first", "_last")).alias("at")).join(placed.select("path", "at", "unit"), ["path", "at"])
    every = core.withColumn("nearness", F.lit(0)).select(*grown.columns).unionByName(grown)
    return every.groupBy(by, "unit").agg(F.min(F.struct("rank", "seed", "path", "at", "nearness")).alias("_o")).select(by, "_o.rank", "_o.seed", "unit", "_o.path", "_o.at", "_o.nearness")


def case_scopes(requests: DataFrame, cases: DataFrame, by: str, text: str = "text") -> DataFrame:
    """``(by, mode, case)``: the cases that a request names, one row each, or mode ``all`` without a case.

    A word with slashes that ends a case's path names that case
    (``literal_path``).  Only where there is none do last names count:
    ``unique_basename``, or ``ambiguous_basename`` where several cases have one.
    """
    words = requests.select(by, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Za-z0-9_.#/-]+"), F.lit(0)))).alias("word"))
    parts = F.split("case", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    ends = cases.select("case", F.posexplode(tails).alias("_k", "word"))
    met = words.join(ends, "word").groupBy(by, "case").agg(F.max(F.col("_k") > 0).alias("literal"))
    any_ = met.groupBy(by).agg(F.bool_or("literal").alias("_any"), F.count("*").alias("_n"))
    kept = met.join(any_, by).where(F.col("literal") | ~F.col("_any"))
    mode = F.when(F.col("_any"), "literal_path").when(F.col("_n") == 1, "unique_basename").otherwise("ambiguous_basename")
    rest = requests.select(by).distinct().join(met, by, "left_anti").select(by, F.lit("all").alias("mode"), F.lit(None).cast("string").alias("case"))
    return kept.select(by, mode.alias("mode"), "case").unionByName(rest)
