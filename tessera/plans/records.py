"""Queries of record contracts, release checks, span quality, audits and splits by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ranges, ranking, records
from tessera.plans.common import HITS_SQL, PASSAGES_SQL, item_hits, table, texts
from tessera.sources import corpus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _whole(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


@query("q98_score_issues", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 'a' END AS judge, o_orderstatus AS st, ['c1', CASE WHEN o_orderkey % 6 = 0 THEN 'c1' ELSE 'c2' END] AS ids,
 [CAST((o_orderkey % 5) / 4 AS DOUBLE), CASE WHEN o_orderkey % 7 = 0 THEN 0.3 ELSE 0.5 END] AS scores, CASE WHEN o_orderkey % 4 = 0 THEN 'not_applicable' ELSE '0.75' END AS gate, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cond FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN judge <> 'a' THEN 'judge' END, CASE WHEN st <> 'F' THEN 'status' END, CASE WHEN o_orderkey % 7 = 0 THEN 'point' END, CASE WHEN o_orderkey % 6 = 0 THEN 'criteria' END,
 CASE WHEN o_orderkey % 13 = 0 THEN 'gates' END, CASE WHEN (cond AND gate = 'not_applicable') OR (NOT cond AND gate <> 'not_applicable') THEN 'conditional' END], lambda x: x IS NOT NULL), ',') AS issues FROM r""")
def q98(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 3
    point = lambda i, s: F.struct(i.alias("criterion_id"), s.cast("string").alias("score"))
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        k.cast("string").alias("sample_id"),
        F.when(k % 11 == 0, "other").otherwise("a").alias("judge_id"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise(F.col("o_orderstatus")).alias("status"),
        F.array(point(F.lit("c1"), k % 5 / 4), point(F.when(k % 6 == 0, "c1").otherwise("c2"), F.when(k % 7 == 0, 0.3).otherwise(0.5))).alias("points"),
        F.when(k % 13 == 0, "none").otherwise("unknown").alias("fact_gate"),
        F.when(k % 4 == 0, "not_applicable").otherwise("0.75").alias("applicability_gate"),
        F.array(F.lit("c2"), F.lit("c1")).alias("expected"),
        F.when(c == 0, True).when(c == 1, False).alias("conditional"),
    )
    return records.score_issues(rows, ("a", "b")).select("o_orderkey", F.array_join("issues", ",").alias("issues"))


@query("q99_delivery_status", """SELECT o_orderkey, CASE WHEN o_orderpriority[1] = '1' AND o_orderstatus = 'P' THEN 'model_anomaly_stop' WHEN o_orderstatus = 'F' AND o_totalprice > 50000 AND n_missing = 0 THEN 'development_evidence_collected' ELSE 'development_incomplete' END AS status
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 ELSE 0 END AS n_missing FROM orders)""")
def q99(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = records.delivery_status(F.startswith("o_orderpriority", F.lit("1")) & (F.col("o_orderstatus") == "P"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 50000, F.when(k % 4 == 0, k % 3).otherwise(0))
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query("q100_violations", """SELECT 'line without order' AS "check", count(*) AS n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'order without customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'part twice', count(*) FROM (SELECT p_partkey FROM part GROUP BY p_partkey HAVING count(*) > 1) UNION ALL SELECT 'text without words', count(*) FROM documents WHERE trim(coalesce(text, '')) = ''""")
def q100(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return records.violations(
        {
            "line without order": line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
            "order without customer": orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
            "part twice": table(spark, d, "part").groupBy("p_partkey").agg(F.count("*").alias("n")).where("n > 1"),
            "text without words": table(spark, d, "documents").where(F.trim(F.coalesce("text", F.lit(""))) == ""),
        }
    )


@query("q101_span_quality", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL}, given AS (SELECT item_id, doc_id, line, min(rank) AS rank, count(*) AS n FROM (SELECT item_id, doc_id, rank, unnest(range("start", "end" + 1)) AS line FROM hits WHERE rank <= 5) GROUP BY ALL),
gold AS (SELECT DISTINCT item_id, doc_id, "start" + 1 AS s, "end" + rank % 2 AS e FROM hits WHERE rank <= 8 AND "end" > "start"),
spans AS (SELECT g.item_id, g.doc_id, s, e, bool_and(rank IS NOT NULL) AS whole, min(rank) AS first FROM (SELECT *, unnest(range(s, e + 1)) AS line FROM gold) g LEFT JOIN given v ON v.item_id = g.item_id AND v.doc_id = g.doc_id AND v.line = g.line GROUP BY ALL),
p AS (SELECT DISTINCT item_id, doc_id, 1 AS p FROM given), a AS (SELECT item_id, round(sum(n - 1) / sum(n), 6) AS d FROM given GROUP BY item_id)
SELECT item_id, count(*) AS n_gold, round(avg(coalesce(p, 0)), 6) AS path_recall, round(avg(CASE WHEN whole THEN 1 ELSE 0 END), 6) AS span_recall, round(coalesce(1 / min(first), 0), 6) AS reciprocal_rank, coalesce(any_value(d), 0) AS duplicate_fraction
FROM spans LEFT JOIN p USING (item_id, doc_id) LEFT JOIN a USING (item_id) GROUP BY item_id""")
def q101(spark: SparkSession, d: str) -> DataFrame:
    hits = item_hits(spark, d, 8)
    gold = hits.where(F.col("end") > F.col("start")).select("item_id", "doc_id", (F.col("start") + 1).alias("start"), (F.col("end") + F.col("rank") % 2).alias("end"))
    return records.span_quality(hits.where("rank <= 5"), gold, "item_id", "doc_id")


@query("q102_macro", "SELECT event_type, count(*) AS n_categories, round(sum(s) / sum(n), 6) AS micro, round(avg(s / n), 6) AS macro FROM (SELECT event_type, user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL) WHERE n > 0 GROUP BY event_type")
def q102(spark: SparkSession, d: str) -> DataFrame:
    return records.macro(table(spark, d, "events"), "event_type", "user_id", "value")


@query("q103_tool_text", """WITH c AS (SELECT user_id AS session, event_id AS call, event_type AS tool FROM events WHERE event_id % 5 <> 0)
SELECT coalesce(tool, 'unknown') AS tool, count(*) AS n_results, CAST(sum(length(t)) AS BIGINT) AS characters, count(*) FILTER (e) AS errors FROM (SELECT user_id AS session, event_id AS call, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS t, event_id % 9 = 0 AS e FROM events) LEFT JOIN c USING (session, call) GROUP BY 1""")
def q103(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("call"), F.col("event_type").alias("tool"), F.floor("value").cast("long").cast("string").alias("text"), (F.col("event_id") % 9 == 0).alias("error"))
    return records.tool_text(rows.where("call % 5 <> 0"), rows.drop("tool"))


_LINES = "string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))"


@query("q104_longest_prefix", f"""WITH l AS (SELECT doc_id, i AS line, sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE length(text) > 0)))
SELECT doc_id, CAST(e AS BIGINT) AS "end", CAST(c AS BIGINT) AS chars, CAST(CASE WHEN e < n THEN e + 1 END AS BIGINT) AS next_line FROM (SELECT doc_id, coalesce(max(line) FILTER (s <= 600), 0) AS e, coalesce(max(s) FILTER (s <= 600), 0) AS c, max(line) AS n FROM l GROUP BY doc_id)""")
def q104(spark: SparkSession, d: str) -> DataFrame:
    return records.longest_prefix(corpus.numbered_lines(texts(spark, d)), "doc_id", 600).select("doc_id", *_whole("end", "chars", "next_line"))


_ASKS = "CASE s_suppkey % 4 WHEN 0 THEN 'plants of ' || lower(n_name) WHEN 1 THEN 'from ' || n_name || ' to FRANCE' WHEN 2 THEN 'in x' || n_name ELSE n_name || '.' END"


@query("q105_mentioned", f"""WITH r AS (SELECT s_suppkey, {_ASKS} AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT s_suppkey, min(n_name) AS m, count(*) AS n FROM r JOIN nation ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || lower(n_name) || '($|[^a-z0-9_])') GROUP BY s_suppkey)
SELECT s_suppkey, CASE WHEN n = 1 THEN m END AS name, coalesce(n, 0) AS n_names FROM r LEFT JOIN f USING (s_suppkey)""")
def q105(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    asks = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.expr(_ASKS).alias("text"))  # 25 nations
    return records.mentioned(asks, nation.select(F.col("n_name").alias("name")), "s_suppkey")


_BLANKS = "CAST(length({0}) - length(replace({0}, ' ', '')) AS BIGINT)"


@query("q106_fitted", f"""WITH RECURSIVE {PASSAGES_SQL}, h AS (SELECT passage_id, CAST("start" AS BIGINT) AS s, CAST("end" AS BIGINT) AS e, string_split(text, chr(10)) AS l, {_BLANKS.format('text')} AS size FROM passages
 UNION ALL SELECT passage_id, s, e, l, {_BLANKS.format("array_to_string(l, ' ')")} - (len(l) - 1) FROM (SELECT passage_id, CASE WHEN k = 0 THEN s ELSE (s + e) // 2 + 1 END AS s, CASE WHEN k = 0 THEN (s + e) // 2 ELSE e END AS e, CASE WHEN k = 0 THEN l[:(s + e) // 2 - s + 1] ELSE l[(s + e) // 2 - s + 2:] END AS l FROM (SELECT *, unnest([0, 1]) AS k FROM h WHERE size > 60 AND s < e)))
SELECT passage_id, s AS "start", e AS "end", size, size > 60 AS over, sha256(array_to_string(l, chr(10))) AS text_sha256 FROM h WHERE size <= 60 OR s >= e""")
def q106(spark: SparkSession, d: str) -> DataFrame:
    units = ranking.passages(texts(spark, d)).select("passage_id", "start", "end", "text")
    blanks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    return records.fitted(units, blanks, 60, ("passage_id",)).select("passage_id", *_whole("start", "end"), "size", "over", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("q107_alternatives", "SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name] ELSE [p_brand || '/' || p_size, p_brand || '/' || p_name] END) AS target FROM part")
def q107(spark: SparkSession, d: str) -> DataFrame:
    grouped = F.concat("p_brand", F.lit("/("), F.col("p_size").cast("string"), F.lit("|"), "p_name", F.lit(")"))
    target = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(grouped)
    return table(spark, d, "part").select("p_partkey", F.explode(records.alternatives(target)).alias("target"))


@query("q108_read_ranges", f"""WITH RECURSIVE {PASSAGES_SQL}, u AS (SELECT passage_id, doc_id, CAST("start" AS BIGINT) AS s, CAST("end" AS BIGINT) AS e, length(text) <= 900 AS whole FROM passages),
a AS (SELECT passage_id, doc_id, CASE WHEN whole THEN s ELSE greatest(s, a - 4) END AS s, CASE WHEN whole THEN e ELSE least(e, a + 4) END AS e FROM (SELECT *, unnest([s, s + (e - s) // 2]) AS a FROM u)),
m AS (SELECT *, CASE WHEN s > max(e) OVER w + 1 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY passage_id, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY passage_id, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT passage_id, doc_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY passage_id, doc_id, island""")
def q108(spark: SparkSession, d: str) -> DataFrame:
    """Short passages whole, of others the lines around two anchors, merged."""
    units = ranking.passages(texts(spark, d)).select("passage_id", "doc_id", *_whole("start", "end"), (F.length("text") <= 900).alias("whole"))
    s, e = F.col("start"), F.col("end")
    anchored = units.withColumn("a", F.explode(F.array(s, s + F.floor((e - s) / 2))))
    low, high = ranges.expand("a", "a", 4, s, e)
    return ranges.merge_ranges(anchored.select("passage_id", "doc_id", F.when(F.col("whole"), s).otherwise(low).alias("start"), F.when(F.col("whole"), e).otherwise(high).alias("end")), ["passage_id", "doc_id"])
