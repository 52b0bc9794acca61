"""Queries of facet scores, routes, references, rule tables, lookups, rebuilds and capped delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import delivery, ranges, routing
from tessera.plans.common import HITS_SQL, PASSAGES_SQL, item_hits, table, texts, tokens_sql
from tessera.plans.graph import EDGES_SQL, SEEDS_SQL, edges, seeds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


QUESTIONS = [(0, "cold ECONOMY parts like ColdBrand", ["Brand#13"]), (1, "small promo of any Brand", []), (2, "STANDARD steel or smallTin", [])]
_STOPS = list(T.STOP)


@query("q86_facet_scores", f"""WITH asked(q, question, cases) AS (VALUES {', '.join(f"({q}, '{t}', {c}::VARCHAR[])" for q, t, c in QUESTIONS)}),
ids AS (SELECT q, list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)), lambda x: NOT list_contains({_STOPS}, x))) AS ids, {tokens_sql('question')} AS t FROM asked),
terms AS (SELECT DISTINCT q, term, CASE WHEN list_contains(ids, term) THEN 2 ELSE 1 END AS weight FROM (SELECT q, ids, unnest(list_concat(t, ids)) AS term FROM ids)),
total AS (SELECT q, sum(weight) AS n FROM terms GROUP BY q),
node AS (SELECT p_partkey AS node, p_brand AS "case", {tokens_sql("p_name || ' ' || p_type")} AS body, {tokens_sql('p_brand')} AS head, {tokens_sql('p_type')} AS path, lower(string_split(p_name, ' ')[1]) AS identity, lower(string_split(p_type, ' ')[1]) AS key FROM part),
m AS (SELECT q, node, "case", sum(CASE WHEN list_contains(body, term) THEN weight ELSE 0 END) AS b, sum(CASE WHEN list_contains(head, term) THEN weight ELSE 0 END) AS h, max(CASE WHEN weight = 2 AND list_contains(path, term) THEN 1 ELSE 0 END) AS p,
  max(CASE WHEN weight = 2 AND identity = term THEN 1 ELSE 0 END) AS i, max(CASE WHEN weight = 2 AND key = term THEN 1 ELSE 0 END) AS k FROM node CROSS JOIN terms GROUP BY ALL)
SELECT q, node, round((30::DOUBLE * b + 8 * h) / n + 4 * i + 4 * k + 2 * p + CASE WHEN list_contains(cases, "case") THEN 4 ELSE 0 END, 6) AS score FROM m JOIN total USING (q) JOIN asked USING (q) WHERE b + h + p > 0 AND (len(cases) = 0 OR list_contains(cases, "case"))""")
def q86(spark: SparkSession, d: str) -> DataFrame:
    word = lambda c: F.get(F.split(c, " "), F.lit(0))
    nodes = table(spark, d, "part").select(
        F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_brand").alias("headings"), F.col("p_type").alias("path"), word("p_name").alias("identity"), word("p_type").alias("key"), F.col("p_brand").alias("case")
    )
    return routing.facet_scores(nodes, spark.createDataFrame(QUESTIONS, "q int, question string, cases array<string>"))


#: ``(relation, factor, bonus, cross_bonus, backward)``.  Parameters.
STEPS = [("SUPPLIED_BY", 0.82, 1.0, 5.0, True), ("BASED_IN", 0.82, 1.0, 5.0, True), ("PART_OF", 0.82, 1.0, 5.0, False)]


def _route(k: int) -> str:
    return f"""
going{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS r FROM front{k - 1}) WHERE r <= 32),
met{k} AS (SELECT q, target AS node, round(score * factor + plus, 9) AS score, {k} AS hop, visited || [target] AS visited FROM going{k} g JOIN steps ON source = g.node WHERE NOT list_contains(visited, target)),
one{k} AS (SELECT q, node, score, hop, visited FROM (SELECT *, row_number() OVER (PARTITION BY q, node ORDER BY score DESC, array_to_string(visited, '>')) AS r2 FROM met{k}) WHERE r2 = 1),
front{k} AS (SELECT m.* FROM one{k} m LEFT JOIN best{k - 1} b ON m.q = b.q AND m.node = b.node WHERE b.score IS NULL OR m.score > b.score),
best{k} AS (SELECT q, node, score, hop, visited FROM (SELECT *, row_number() OVER (PARTITION BY q, node ORDER BY score DESC, hop) AS r3 FROM (SELECT * FROM best{k - 1} UNION ALL SELECT * FROM front{k})) WHERE r3 = 1)"""


@query("q87_routes", f"""WITH {EDGES_SQL}, {SEEDS_SQL}, rule(relation, factor, plus, back) AS (VALUES ('SUPPLIED_BY', 0.82::DOUBLE, 5::DOUBLE, true), ('BASED_IN', 0.82, 5, true), ('PART_OF', 0.82, 1, false)),
steps AS (SELECT source, target, factor, plus FROM one JOIN rule USING (relation) UNION ALL SELECT target, source, factor, plus FROM one JOIN rule USING (relation) WHERE back),
front0 AS (SELECT q, node, score, 0 AS hop, [node] AS visited FROM seeds), best0 AS (SELECT * FROM front0), {','.join(map(_route, (1, 2, 3)))}
SELECT q, node, score, hop, visited[1] AS origin, array_to_string(visited, '>') AS route FROM best3""")
def q87(spark: SparkSession, d: str) -> DataFrame:
    links = edges(spark, d).withColumn("cross", F.col("relation") != "PART_OF")
    return routing.routes(seeds(spark, d), links, spark.createDataFrame(STEPS, "relation string, factor double, bonus double, cross_bonus double, backward boolean"), "q")


@query("q88_neighbourhood", f"""WITH {EDGES_SQL}, {SEEDS_SQL}, w AS (SELECT DISTINCT source, target FROM edges), a AS (SELECT DISTINCT q, node, 0 AS d FROM seeds),
b AS (SELECT DISTINCT q, target AS node, 1 AS d FROM a JOIN w ON source = node), c AS (SELECT DISTINCT q, target AS node, 2 AS d FROM b JOIN w ON source = node),
n AS (SELECT q, node, min(d) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL)
SELECT q, node, distance, coalesce(degree, 0) AS degree FROM n LEFT JOIN (SELECT source AS node, count(*) AS degree FROM w GROUP BY source) USING (node)""")
def q88(spark: SparkSession, d: str) -> DataFrame:
    return routing.neighbourhood(seeds(spark, d), edges(spark, d), "q")


@query("q89_references", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL}, r AS (SELECT item_id, doc_id, max(score) AS score FROM hits GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM r) WHERE r <= 8),
m AS (SELECT item_id, t.doc_id + 1 AS doc_id, score * CASE WHEN source = 'src' || (item_id % 5) THEN 0.88::DOUBLE ELSE 0.65 END AS score FROM t JOIN documents d ON d.doc_id = t.doc_id)
SELECT item_id, doc_id, round(max(score), 9) AS score FROM (SELECT item_id, doc_id, score FROM r UNION ALL SELECT * FROM m) GROUP BY ALL""")
def q89(spark: SparkSession, d: str) -> DataFrame:
    ranked = item_hits(spark, d).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    refs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") + 1).alias("target"), F.col("source").alias("key"))
    asked = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("key"))
    return routing.referred(ranked, refs, asked, "item_id", "doc_id")


RULES = [
    {"any": ["building", "furniture"], "wants": ["steel", "brass"], "without": ["economy"], "weight": 30},
    {"any": ["building"], "wants": ["polished"], "weight": 20},
    {"any": ["automobile", "machinery"], "wants": ["tin"], "without": ["small", "promo"], "weight": 25},
    {"any": ["machinery"], "wants": ["steel"], "weight": -10},
    {"any": ["household", "automobile"], "wants": ["anodized", "plated"], "weight": 12},
]


def _holds(column: str, phrases: list[str]) -> str:
    return "(" + (" OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) or "false") + ")"


_RULES_SQL = " + ".join(f"CASE WHEN {_holds('c_mktsegment', r['any'])} AND {_holds('t', r['wants'])} AND NOT {_holds('t', r.get('without', []))} THEN {r['weight']} ELSE 0 END" for r in RULES)


@query("q90_rule_scores", f"""WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), p AS (SELECT p_partkey, p_name || ' ' || p_type AS t FROM part), x AS (SELECT c_mktsegment, p_partkey, CAST({_RULES_SQL} AS DOUBLE) AS score FROM s CROSS JOIN p),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, p_partkey) AS place FROM x WHERE score > 0) WHERE place <= 10)
SELECT c_custkey, p_partkey, score, place FROM customer JOIN b USING (c_mktsegment)""")
def q90(spark: SparkSession, d: str) -> DataFrame:
    asks = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("text"))
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return routing.rule_scores(asks, parts, RULES, "c_custkey", "p_partkey").withColumn("place", F.col("place").cast("long"))


_ASKS = "CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'at ' || n_nationkey WHEN 2 THEN 'plants in ' || lower(n_name) ELSE 'nowhere' END"
_WORDS = "regexp_extract_all(lower({}), '[a-z_][a-z_0-9]*|[0-9]+')"


@query("q91_resolved", f"""WITH r AS (SELECT s_suppkey, {_ASKS} AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT n_name, unnest(list_distinct({_WORDS.format('n_name')})) AS t FROM nation), v AS (SELECT s_suppkey, unnest(list_distinct({_WORDS.format('text')})) AS t FROM r),
c AS (SELECT s_suppkey, n_name, count(*) AS n FROM v JOIN w USING (t) GROUP BY ALL), near AS (SELECT s_suppkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY n DESC, n_name) AS k FROM c) WHERE k = 1)
SELECT r.s_suppkey, coalesce(e.n_name, a.n_name, near.n_name) AS name, CASE WHEN e.n_name IS NOT NULL THEN 'exact' WHEN a.n_name IS NOT NULL THEN 'alias' WHEN near.n_name IS NOT NULL THEN 'terms' END AS how
FROM r LEFT JOIN nation e ON e.n_name = r.text LEFT JOIN nation a ON 'at ' || a.n_nationkey = r.text LEFT JOIN near ON near.s_suppkey = r.s_suppkey""")
def q91(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    asks = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.expr(_ASKS).alias("text"))  # 25 nations
    aliases = nation.select(F.concat(F.lit("at "), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("name"))
    return routing.resolved(asks, nation.select(F.col("n_name").alias("name")), aliases, "s_suppkey")


@query("q92_targets", """WITH r AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) AS key, CASE WHEN s_suppkey % 7 = 0 THEN 'large' ELSE (s_suppkey % 60) || '.50' END AS value FROM supplier),
f AS (SELECT p_brand AS key, p_size + 0.5 AS v, count(*) AS n, min(p_partkey) AS fact FROM part GROUP BY ALL)
SELECT s_suppkey, CASE WHEN value = 'large' THEN 'unsupported' WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS status, CASE WHEN n = 1 THEN fact END AS fact FROM r LEFT JOIN f ON f.key = r.key AND f.v = TRY_CAST(r.value AS DOUBLE)""")
def q92(spark: SparkSession, d: str) -> DataFrame:
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string"))
    value = F.when(F.col("s_suppkey") % 7 == 0, "large").otherwise(F.concat((F.col("s_suppkey") % 60).cast("string"), F.lit(".50")))
    facts = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("value"), F.col("p_partkey").alias("fact"))
    return routing.targets(table(spark, d, "supplier").select("s_suppkey", brand.alias("key"), value.alias("value")), facts, "s_suppkey")


@query("q93_rebuilt", """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE h END AS a FROM h WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, h AS b FROM h WHERE doc_id % 5 <> 1)
SELECT doc_id, CASE WHEN b IS NULL THEN 'deleted' WHEN a = b THEN 'reused' ELSE 'parsed' END AS state FROM o FULL JOIN n USING (doc_id)""")
def q93(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental build over a changed corpus parses, keeps and deletes."""
    i = F.col("doc_id")
    now = texts(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    old = now.where(i % 7 != 0).withColumn("sha256", F.when(i % 10 == 0, "stale").otherwise(F.col("sha256")))
    return routing.rebuilt(old, now.where(i % 5 != 1), "doc_id")


@query("q94_canonical", "SELECT doc_id, min(doc_id) OVER w AS canonical, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))")
def q94(spark: SparkSession, d: str) -> DataFrame:
    return routing.canonical(texts(spark, d), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


FOLLOWS = {"view": ("click", "error"), "click": ("purchase", "view", "error"), "signup": ("view",), "purchase": ()}


@query("q95_transitions")
def q95(spark: SparkSession, d: str) -> DataFrame:
    """The state each user ends in when steps out of order are refused: a fold, so it has no SQL."""
    return routing.transitions(table(spark, d, "events"), "user_id", "event_id", "event_type", FOLLOWS)


@query("q96_family_split", """WITH f AS (SELECT DISTINCT lang, sha256(coalesce(text, '')) AS family FROM documents WHERE lang IS NOT NULL)
SELECT lang, family, CASE WHEN 10 * row_number() OVER (PARTITION BY lang ORDER BY family) <= 6 * count(*) OVER (PARTITION BY lang) THEN 'first' ELSE 'second' END AS split FROM f""")
def q96(spark: SparkSession, d: str) -> DataFrame:
    """Six in ten families of each language go to the first split, whole, by their hash."""
    families = texts(spark, d).where("lang is not null").select("lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("family")).distinct()
    n = families.groupBy("lang").agg(F.count("*").alias("n"))
    placed = ranges.numbered(families, ["family"], ["lang"]).join(n, "lang")
    return placed.select("lang", "family", F.when(10 * F.col("place") <= 6 * F.col("n"), "first").otherwise("second").alias("split"))


CAP = 4_000
_LINES = "string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))"


@query("q97_json_delivery", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL}, g AS (SELECT item_id, rank, CAST(h.doc_id AS VARCHAR) AS path, "start", "end" AS last, {_LINES} AS l FROM hits h JOIN documents d ON h.doc_id = d.doc_id WHERE rank <= 10),
x AS (SELECT * EXCLUDE (l), l[number] AS text FROM (SELECT *, unnest(range("start", last + 1)) AS number FROM g)),
s AS (SELECT *, {len(delivery.UNIT)} + length(path) + 2 + length(CAST("start" AS VARCHAR)) + length(CAST(rank AS VARCHAR)) + CASE WHEN rank > 1 THEN 1 ELSE 0 END AS unit, {len(delivery.LINE)} + length(CAST(number AS VARCHAR)) + length(CAST(to_json(text) AS VARCHAR)) + CASE WHEN number > "start" THEN 1 ELSE 0 END AS own FROM x),
t AS (SELECT *, {len(delivery.OPEN + delivery.CLOSE)} + coalesce(sum(own + CASE WHEN number = last THEN unit + length(CAST(last AS VARCHAR)) ELSE 0 END) OVER (PARTITION BY item_id ORDER BY rank, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + own + unit + length(CAST(number AS VARCHAR))
  + CASE WHEN number < last THEN {len(delivery.NEXT)} + length(CAST(number + 1 AS VARCHAR)) ELSE 0 END AS trial FROM s),
o AS (SELECT *, max(CASE WHEN trial > {CAP} THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY rank, number ROWS UNBOUNDED PRECEDING) AS over, max(trial) OVER (PARTITION BY item_id) AS most FROM t),
k AS (SELECT *, max(over) OVER (PARTITION BY item_id) = 1 AS truncated FROM o)
SELECT item_id, rank, path, CAST("start" AS BIGINT) AS "start", CAST(max(number) AS BIGINT) AS "end", CAST(CASE WHEN max(number) < last THEN max(number) + 1 END AS BIGINT) AS next_line, truncated FROM k WHERE over = 0 AND (truncated OR most + 1 <= {CAP}) GROUP BY item_id, rank, path, "start", last, truncated""")
def q97(spark: SparkSession, d: str) -> DataFrame:
    hits = item_hits(spark, d, 10).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("last"))
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("l", T.lines(F.col("text"))).drop("text")
    cut_ = hits.join(docs, "doc_id").withColumn("l", F.slice("l", F.col("start").cast("int"), (F.col("last") - F.col("start") + 1).cast("int")))
    lines = cut_.select("item_id", "rank", F.col("doc_id").cast("string").alias("path"), "start", "last", F.posexplode("l").alias("k", "text")).withColumn("number", F.col("start") + F.col("k"))
    return delivery.deliver_json(lines, "item_id", CAP)
