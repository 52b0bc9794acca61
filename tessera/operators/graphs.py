"""Typed graphs: expansion by hops, walks with restart and components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, shared_dir


def both_ways(edges: DataFrame) -> DataFrame:
    """``edges (source, target, ...)`` with each one reversed as well."""
    others = [c for c in edges.columns if c not in ("source", "target")]
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *others))


def expand(seeds: DataFrame, edges: DataFrame, decay: DataFrame, query: str, depth: int = 3, beam: int = 32) -> DataFrame:
    """Best score of each node reached: ``(query, node, score, hop)``.

    ``seeds`` has ``(query, node, score)``, ``decay`` a factor for each
    relation.  At each hop the ``beam`` best nodes of a query (score, then
    node) go on; a node counts again only with a strictly greater score.
    """
    typed = cut(edges.join(F.broadcast(decay), "relation").select(F.col("source").alias("node"), "target", "factor"))  # one row a relation
    best = seeds.select(query, "node", "score", F.lit(0).alias("hop"))
    frontier = best
    for hop in range(1, depth + 1):
        wide = Window.partitionBy(query).orderBy(F.desc("score"), "node")
        going = frontier.withColumn("_r", F.row_number().over(wide)).where(F.col("_r") <= beam)
        met = (
            going.join(typed, "node")
            .select(query, F.col("target").alias("node"), F.round(F.col("score") * F.col("factor"), 9).alias("score"))
            .groupBy(query, "node")
            .agg(F.max("score").alias("score"))
        )
        known = best.select(query, "node", F.col("score").alias("old"))
        frontier = cut(met.join(known, [query, "node"], "left").where("old is null or score > old").select(query, "node", "score", F.lit(hop).alias("hop")))
        both = best.unionByName(frontier)
        best = cut(both.groupBy(query, "node").agg(F.max_by("hop", F.struct("score", -F.col("hop"))).alias("hop"), F.max("score").alias("score")).select(query, "node", "score", "hop"))
    return best


def restart_walk(seeds: DataFrame, edges: DataFrame, decay: DataFrame, query: str, rounds: int = 3, keep: float = 0.65, forward: tuple[str, ...] = (), allowed: DataFrame | None = None) -> DataFrame:
    """``(query, node, mass)``: visits of a walk that goes on with ``keep`` and restarts else, averaged over the rounds.

    A step is taken along edges both ways (those of relations in ``forward``
    one way) in proportion to the relation's factor in ``decay``; other
    relations, and targets that are not in ``allowed (node)``, are no steps.
    Where a node has no step its mass ends.  Negative scores count as 0; a query
    whose scores sum to 0 has no rows.
    """
    typed = edges.join(F.broadcast(decay), "relation")  # one row a relation
    back = typed.where(~F.col("relation").isin(*forward)) if forward else typed
    ways = typed.select("source", "target", "factor").unionByName(back.select(F.col("target").alias("source"), F.col("source").alias("target"), "factor"))
    if allowed is not None:
        ways = ways.join(allowed.select(F.col("node").alias("target")), "target", "left_semi")
    steps = ways.groupBy("source", "target").agg(F.sum("factor").alias("factor"))
    sums = steps.groupBy("source").agg(F.sum("factor").alias("all"))
    steps = cut(steps.join(sums, "source").select(F.col("source").alias("node"), "target", (F.col("factor") / F.col("all")).alias("share")))
    score = F.greatest(F.col("score"), F.lit(0.0))
    start = cut(seeds.withColumn("_t", F.sum(score).over(Window.partitionBy(query))).where("_t > 0").select(query, "node", (score / F.col("_t")).alias("mass")))
    mass, visits = start, []
    for _ in range(rounds):
        moved = mass.join(steps, "node").select(query, F.col("target").alias("node"), (F.col("mass") * F.col("share") * keep).alias("mass"))
        again = start.select(query, "node", (F.col("mass") * (1 - keep)).alias("mass"))
        mass = cut(moved.unionByName(again).groupBy(query, "node").agg(F.sum("mass").alias("mass")))
        visits.append(mass)
    every = reduce(DataFrame.unionByName, visits)
    return every.groupBy(query, "node").agg((F.sum("mass") / rounds).alias("mass"))


def unit_mass(mass: DataFrame, units: DataFrame, query: str) -> DataFrame:
    """``(query, unit, mass)``: the mass of the nodes of each unit; ``units`` is ``(node, unit)``."""
    return mass.join(units, "node").groupBy(query, "unit").agg(F.sum("mass").alias("mass"))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)``: the least node reachable, edges taken both ways.

    Each round takes the least label of the neighbours and then the label of
    the label, so rounds grow with the logarithm of long paths; the table of
    labels is checkpointed to the shared folder each round.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    links = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().checkpoint()
    labels = links.select(F.col("source").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        near = links.join(labels.select(F.col("node").alias("target"), "component"), "target").groupBy("source").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["source"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("c"), F.col("component").alias("old"))
        hop = least.select(F.col("node").alias("c"), F.col("c").alias("up"))
        nxt = least.join(hop, "c").select("node", F.least("c", "up").alias("component"), "old").checkpoint()
        labels = nxt.select("node", "component")
        if nxt.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def closure(roots: DataFrame, includes: DataFrame, max_depth: int = 30) -> DataFrame:
    """``(root, node, depth)``: what each root includes, directly or not; cycles end by themselves, chains of over ``max_depth`` steps are an error."""
    shared_dir(roots.sparkSession)
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, max_depth + 1):
        front = (
            front.join(includes.select(F.col("source").alias("node"), "target"), "node")
            .select("root", F.col("target").alias("node"), F.lit(depth).alias("depth"))
            .distinct()
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
            .checkpoint()
        )
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"what is included goes deeper than {max_depth} steps")
