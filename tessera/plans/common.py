"""Tables, and inputs that queries of several modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ranking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``; where the files give fewer splits than there are cores, rows are dealt out evenly first."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, size)``: a listing made of the customers' and orders' keys, with markers, logs, times and probes."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customers = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
        .select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("dir"))
    )
    k = F.col("c_custkey")
    name = lambda c, n: F.when(c, F.lit(n))
    own = customers.select("dir", k.alias("k"), F.explode(F.filter(F.array(name(k % 5 == 0, "Allrun"), name(k % 15 == 0, "Allclean"), name(k % 4 == 0, "README"), name(k % 6 == 0, "README.md")), lambda x: x.isNotNull())).alias("f"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    o = F.col("o_orderkey")
    parts = F.array(
        name(o % 2 == 0, "Allrun"),
        name(o % 3 == 0, "Allclean"),
        name(o % 4 == 1, "log.solver"),
        name(o % 8 == 1, "processor0/log.solver"),
        F.when(o % 5 == 0, F.concat((o % 7).cast("string"), F.lit("."), (o % 10).cast("string"), F.lit("/U"))),
        F.when(o % 6 == 0, F.concat(F.lit("postProcessing/probes/0/"), F.element_at(F.array(F.lit("p"), F.lit("T"), F.lit("rho")), (o % 3 + 1).cast("int")))),
    )
    deep = orders.select(F.concat_ws("/", "dir", o.cast("string")).alias("dir"), o.alias("k"), F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("f"))
    return own.unionByName(deep).select(F.concat_ws("/", "dir", "f").alias("path"), (F.col("k") % 9).alias("size"))


CASE_FILES_SQL = """
cust AS (SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS dir FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
marks AS (SELECT dir, c_custkey AS k, unnest([CASE WHEN c_custkey % 5 = 0 THEN 'Allrun' END, CASE WHEN c_custkey % 15 = 0 THEN 'Allclean' END,
    CASE WHEN c_custkey % 4 = 0 THEN 'README' END, CASE WHEN c_custkey % 6 = 0 THEN 'README.md' END]) AS f FROM cust
  UNION ALL
  SELECT dir || '/' || o_orderkey, o_orderkey, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'Allrun' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Allclean' END,
    CASE WHEN o_orderkey % 4 = 1 THEN 'log.solver' END, CASE WHEN o_orderkey % 8 = 1 THEN 'processor0/log.solver' END,
    CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 7) || '.' || (o_orderkey % 10) || '/U' END,
    CASE WHEN o_orderkey % 6 = 0 THEN 'postProcessing/probes/0/' || (['p', 'T', 'rho'])[o_orderkey % 3 + 1] END]) FROM orders JOIN cust ON o_custkey = c_custkey),
files AS (SELECT dir || '/' || f AS path, k % 9 AS size FROM marks WHERE f IS NOT NULL)
"""


def case_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.corpus import complete_cases

    return complete_cases(case_files(spark, sf_dir).select("path"))


CASES_SQL = """
held AS (SELECT regexp_replace(path, '/[^/]*$', '') AS c FROM files WHERE regexp_extract(path, '[^/]*$') IN ('Allrun', 'Allclean') GROUP BY 1 HAVING count(DISTINCT regexp_extract(path, '[^/]*$')) = 2),
cases AS (SELECT c AS "case" FROM held a WHERE NOT EXISTS (SELECT 1 FROM held b WHERE starts_with(a.c, b.c || '/')))
"""


def item_hits(spark: SparkSession, sf_dir: str, limit: int = 64) -> DataFrame:
    """``(item_id, passage_id, score, rank, doc_id, start, end)``: the best passages of each benchmark item."""
    units = ranking.passages(texts(spark, sf_dir))
    return ranking.bm25(units, table(spark, sf_dir, "benchmark"), "passage_id", "item_id", limit, keep=("doc_id", "start", "end"))


#: Passages, and tokens as `tokens()` gives them for texts without CJK.  RE2 has no lookahead: a bar is set before each
#: capital that other than a capital follows, so runs of capitals end at bars or at the end.
PASSAGES_SQL = """
dl AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE length(text) > 0),
pack AS (SELECT doc_id, l, 1 AS n, 1 AS first, length(l[1]) + 1 AS size, NULL::BIGINT AS done FROM dl
  UNION ALL
  SELECT doc_id, l, n + 1, CASE WHEN size + length(l[n + 1]) + 1 > 1500 THEN n + 1 ELSE first END,
         CASE WHEN size + length(l[n + 1]) + 1 > 1500 THEN length(l[n + 1]) + 1 ELSE size + length(l[n + 1]) + 1 END, NULL FROM pack WHERE n < len(l)),
ends AS (SELECT doc_id, first, max(n) AS "end" FROM pack GROUP BY doc_id, first),
passages AS (SELECT doc_id, CAST(greatest(1, first - 4) AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end",
    sha256(doc_id || ':' || greatest(1, first - 4) || ':' || "end")[:24] AS passage_id, array_to_string(l[greatest(1, first - 4):"end"], chr(10)) AS text FROM ends JOIN dl USING (doc_id))
"""


def tokens_sql(text: str) -> str:
    words = f"regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z_0-9]*')"
    barred = f"regexp_replace(array_to_string({words}, ' '), '([A-Z])([^A-Z])', '|\\1\\2', 'g')"
    pieces = f"list_transform(regexp_extract_all({barred}, '[A-Z]?[a-z]+|[A-Z]+[|]|[A-Z]+$|[0-9]+'), lambda x: replace(x, '|', ''))"
    stop = "['a','an','the','of','to','and','in','for','is','on','with','as','from']"
    return f"list_filter(list_transform(list_concat({words}, {pieces}), lambda x: lower(x)), lambda x: NOT list_contains({stop}, x))"


def hits_sql(unit_text: str = "text", asked_text: str = "text") -> str:
    """The best passages of each benchmark item; expressions give the texts of both."""
    return f"""
coded AS (SELECT passage_id, {tokens_sql(unit_text)} AS t FROM passages),
totals AS (SELECT count(*) AS n_units, greatest(1.0, avg(len(t))) AS mean_length FROM coded),
asked AS (SELECT item_id, term, least(count(*), 2) AS qf FROM (SELECT item_id, unnest({tokens_sql(asked_text)}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT passage_id, len(t) AS length, term, count(*) AS tf FROM (SELECT passage_id, t, unnest(t) AS term FROM coded) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT item_id, passage_id, round(sum(ln(1 + (n_units - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) * qf), 6) AS score
    FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN totals GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, passage_id) AS rank FROM scored WHERE score > 0) JOIN (SELECT passage_id, doc_id, "start", "end" FROM passages) USING (passage_id) WHERE rank <= 64)
"""


HITS_SQL = hits_sql()
