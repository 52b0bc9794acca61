"""Queries over a typed graph made of parts, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, graphs, ranking
from tessera.plans.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Factor of the score along a relation.  Parameters.
DECAY = [("SUPPLIED_BY", 0.6), ("BASED_IN", 0.5), ("PART_OF", 0.4)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    line, sup, nat = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    part = line.select(node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target"), F.lit("SUPPLIED_BY").alias("relation")).distinct()
    based = sup.select(node("s", "s_suppkey").alias("source"), node("n", "s_nationkey").alias("target"), F.lit("BASED_IN").alias("relation"))
    of = nat.select(node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target"), F.lit("PART_OF").alias("relation"))
    return part.unionByName(based).unionByName(of)


EDGES_SQL = """
one AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'SUPPLIED_BY' AS relation FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BASED_IN' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation),
edges AS (SELECT * FROM one UNION ALL SELECT target, source, relation FROM one),
decay(relation, factor) AS (VALUES ('SUPPLIED_BY', 0.6::DOUBLE), ('BASED_IN', 0.5::DOUBLE), ('PART_OF', 0.4::DOUBLE)),
typed AS (SELECT source, target, factor FROM edges JOIN decay USING (relation))
"""


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """``(q, node, score)``: parts by the words of a type and a brand, with a little for the price."""
    parts = table(spark, d, "part")
    words = F.array("p_type", "p_brand", F.element_at(F.split("p_name", " "), 1))
    asked = F.array(*[F.array(*map(F.lit, w)) for w in (("ECONOMY", "cold"), ("PROMO", "small"), ("STANDARD", "Brand#13"))])
    scored = parts.select(F.posexplode(asked).alias("q", "w"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), words.alias("words"), "p_retailprice")
    score = 12.0 * F.size(F.array_intersect("words", "w")) / F.size("w") + F.col("p_retailprice") / 10000
    top = scored.where(F.size(F.array_intersect("words", "w")) > 0).select("q", "node", F.round(score, 6).alias("score"))
    return ranking.top(top, ["q"], [F.desc("score"), F.asc("node")], 32, "r").drop("r")


SEEDS_SQL = """
asked(q, w) AS (VALUES (0, ['ECONOMY', 'cold']), (1, ['PROMO', 'small']), (2, ['STANDARD', 'Brand#13'])),
cand AS (SELECT q, 'p' || p_partkey AS node, len(list_intersect(list_distinct([p_type, p_brand, string_split(p_name, ' ')[1]]), w)) AS o, len(w) AS n, p_retailprice FROM part CROSS JOIN asked),
seeds AS (SELECT q, node, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS r FROM (SELECT q, node, round(12.0::DOUBLE * o / n + p_retailprice / 10000, 6) AS score FROM cand WHERE o > 0)) WHERE r <= 32)
"""


@query("q20_seeds", f"WITH {SEEDS_SQL} SELECT q, node, score FROM seeds")
def q20(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d)


def _hop(k: int) -> str:
    return f"""
going{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS r FROM front{k - 1}) WHERE r <= 32),
met{k} AS (SELECT q, target AS node, max(round(score * factor, 9)) AS score FROM going{k} JOIN typed ON source = node GROUP BY ALL),
front{k} AS (SELECT m.q, m.node, m.score, {k} AS hop FROM met{k} m LEFT JOIN best{k - 1} b ON m.q = b.q AND m.node = b.node WHERE b.score IS NULL OR m.score > b.score),
best{k} AS (SELECT q, node, arg_max(hop, score) AS hop, max(score) AS score FROM (SELECT q, node, score, hop FROM best{k - 1} UNION ALL SELECT q, node, score, hop FROM front{k}) GROUP BY q, node)"""


@query("q22_expansion", f"WITH {EDGES_SQL}, {SEEDS_SQL}, front0 AS (SELECT q, node, score, 0 AS hop FROM seeds), best0 AS (SELECT * FROM front0), {','.join(map(_hop, (1, 2, 3)))} SELECT q, node, score, hop FROM best3")
def q22(spark: SparkSession, d: str) -> DataFrame:
    return graphs.expand(seeds(spark, d), graphs.both_ways(edges(spark, d).withColumn("weight", F.lit(1.0))), spark.createDataFrame(DECAY, "relation string, factor double"), "q")


@query("q21_best_units", f"WITH {SEEDS_SQL}, u AS (SELECT q, p_brand AS unit, arg_max(node, (score, node)) AS node, max(score) AS score FROM seeds JOIN part ON node = 'p' || p_partkey GROUP BY ALL) SELECT q, unit, node, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS place FROM u")
def q21(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    unit = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("unit"))
    best = seeds(spark, d).join(unit, "node").groupBy("q", "unit").agg(F.max_by("node", F.struct("score", "node")).alias("node"), F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node")).cast("long"))


def _walk(k: int) -> str:
    return f"mass{k} AS (SELECT q, node, sum(mass) AS mass FROM (SELECT q, target AS node, mass * share * 0.65 AS mass FROM mass{k - 1} JOIN steps ON source = node UNION ALL SELECT q, node, mass * (1 - 0.65::DOUBLE) FROM mass0) GROUP BY ALL)"


_WALK_SQL = f"""{EDGES_SQL}, {SEEDS_SQL}, ways AS (SELECT source, target, sum(factor) AS factor FROM (SELECT source, target, factor FROM one JOIN decay USING (relation) UNION ALL SELECT target, source, factor FROM one JOIN decay USING (relation) WHERE relation <> 'PART_OF') GROUP BY ALL),
steps AS (SELECT source, target, factor / sum(factor) OVER (PARTITION BY source) AS share FROM ways),
mass0 AS (SELECT q, node, score / sum(score) OVER (PARTITION BY q) AS mass FROM seeds), {', '.join(map(_walk, (1, 2, 3)))},
walked AS (SELECT q, node, sum(mass) / 3 AS mass FROM (SELECT * FROM mass1 UNION ALL SELECT * FROM mass2 UNION ALL SELECT * FROM mass3) GROUP BY q, node)"""


def walked(spark: SparkSession, d: str) -> DataFrame:
    return graphs.restart_walk(seeds(spark, d), edges(spark, d), spark.createDataFrame(DECAY, "relation string, factor double"), "q", forward=("PART_OF",))


@query("q25_restart_walk", f"WITH {_WALK_SQL} SELECT q, node, round(mass, 8) AS mass FROM walked")
def q25(spark: SparkSession, d: str) -> DataFrame:
    return walked(spark, d).select("q", "node", F.round("mass", 8).alias("mass"))


@query("q56_unit_mass", f"WITH {_WALK_SQL} SELECT q, p_brand AS unit, round(sum(mass), 8) AS mass FROM walked JOIN part ON node = 'p' || p_partkey GROUP BY ALL")
def q56(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("unit"))
    return graphs.unit_mass(walked(spark, d), units, "q").select("q", "unit", F.round("mass", 8).alias("mass"))


@query("q26_components", """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
reach AS (SELECT x AS node, x AS other FROM b UNION SELECT reach.node, b.y FROM reach JOIN b ON reach.other = b.x),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT component, count(*) AS n_nodes, count(DISTINCT CASE WHEN node[1] = 'c' THEN node END) AS n_owners FROM comp GROUP BY component""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    link = lambda t, k, a, m, b: table(spark, d, t).select(F.concat(F.lit(k), F.col(a).cast("string")).alias("source"), F.concat(F.lit(m), F.col(b).cast("string")).alias("target"))
    links = link("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(link("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    found = graphs.components(links)
    return found.groupBy("component").agg(F.count("*").alias("n_nodes"), F.countDistinct(F.when(F.col("node").startswith("c"), F.col("node"))).alias("n_owners"))


@query("q24_unique_match", "WITH u AS (SELECT p_type, p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL HAVING count(*) = 1) SELECT s_suppkey, p_type, p_brand, p_size, p_partkey FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) AS p_brand, CAST(s_nationkey + 1 AS INTEGER) AS p_size FROM supplier) JOIN u USING (p_brand, p_size)")
def q24(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), (F.col("s_nationkey") + 1).cast("int").alias("p_size"))
    right = table(spark, d, "part").select("p_type", "p_brand", "p_size", "p_partkey")
    keyed = left.join(right.select("p_type", "p_brand", "p_size").distinct(), ["p_brand", "p_size"])
    return evaluation.unique_match(keyed, right, ["p_type", "p_brand", "p_size"], "p_partkey").select("s_suppkey", "p_type", "p_brand", "p_size", "p_partkey")


@query("q37_closure", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey // 3 AS b FROM customer UNION SELECT DISTINCT c_nationkey, c_custkey % 7 FROM customer),
r AS (SELECT DISTINCT c_custkey AS root, c_custkey AS node FROM customer UNION SELECT root, b FROM r JOIN e ON node = a)
SELECT root, count(*) AS n_reached FROM r GROUP BY root""")
def q37(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    up = c.select(F.col("c_custkey").alias("source"), F.expr("c_custkey div 3").alias("target"))
    over = c.select(F.col("c_nationkey").cast("long").alias("source"), (F.col("c_custkey") % 7).alias("target"))
    return graphs.closure(c.select(F.col("c_custkey").alias("root")).distinct(), up.unionByName(over).distinct(), 200).groupBy("root").agg(F.count("*").alias("n_reached"))
