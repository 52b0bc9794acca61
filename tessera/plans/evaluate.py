"""Queries of scores, agreement, sampling, contracts, logs and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, logs, ranges
from tessera.plans import log_rules
from tessera.plans.common import table
from tessera.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


#: Log lines made of events: what each type of event says.
SAID = {
    "error": "--> FOAM FATAL ERROR: keyword gamma is undefined",
    "signup": "--> FOAM Warning : undefined faces put into the default patch",
    "purchase": "--> FOAM Warning : cannot find required object overPressure",
    "click": "\tTime step done ",
    "view": "",
}
_SAID_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAID.items()) + " ELSE 'min(T): ' || CAST(CAST(value - 50 AS INTEGER) AS VARCHAR) END"


def said() -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv]), F.col("event_type"))
    return F.coalesce(known, F.concat(F.lit("min(T): "), F.rint(F.col("value") - 50).cast("int").cast("string")))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("line"), said().alias("text"))


_LOG_SQL = f"""lg AS (SELECT user_id, event_id AS line, {_SAID_SQL} AS text FROM events),
ctx AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS st FROM lg),
near AS (SELECT *, list(st) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 5 FOLLOWING) AS f, list(st) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 8 FOLLOWING) AS w,
  CASE WHEN regexp_matches(text, '{log_rules.FATAL}') THEN 0 WHEN regexp_matches(text, '{log_rules.WARNING}') THEN 1 END AS kind FROM ctx),
msg AS (SELECT user_id, line, kind, array_to_string(list_filter(CASE kind WHEN 0 THEN f ELSE w END, lambda x: x <> ''), chr(10)) AS whole FROM near WHERE kind IS NOT NULL),
judged AS (SELECT user_id, line, whole[:1200] AS message, {log_rules.verdict_sql("whole", ["lower(whole[:1200])", "lower(whole)"])} AS v FROM msg),
found AS (SELECT user_id, line, v.severity AS severity, v.category AS category, v.blocking AS blocking, message FROM judged)"""


@query("q47_diagnostics", f"WITH {_LOG_SQL} SELECT user_id, line, severity, category, blocking, sha256(message) AS message_sha256 FROM found")
def q47(spark: SparkSession, d: str) -> DataFrame:
    found = logs.diagnose(log_lines(spark, d), log_rules.KINDS, "user_id")
    return found.select("user_id", "line", "severity", "category", "blocking", F.sha2(F.col("message").cast("binary"), 256).alias("message_sha256"))


_SEVERITIES = ", ".join(f"count(*) FILTER (severity = '{k}') AS n_{k}" for k in ("fatal", "error", "warning", "nonblocking_warning"))


@query("q48_severities", f"""WITH {_LOG_SQL}, c AS (SELECT user_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT user_id, category, count(*) AS n FROM found GROUP BY ALL) GROUP BY user_id)
SELECT * FROM (SELECT user_id, {_SEVERITIES}, count(*) FILTER (blocking) AS n_blocking FROM found GROUP BY user_id) JOIN c USING (user_id)""")
def q48(spark: SparkSession, d: str) -> DataFrame:
    counts = logs.severity_counts(logs.diagnose(log_lines(spark, d), log_rules.KINDS, "user_id"), "user_id")
    named = F.transform(F.sort_array(F.map_entries("categories")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counts.withColumn("categories", F.array_join(named, ","))


@query("q54_run_status", f"""WITH lg AS (SELECT user_id, event_id AS line, {_SAID_SQL} AS text FROM events),
s AS (SELECT user_id, count(*) FILTER (regexp_matches(text, '{log_rules.FATAL}')) AS n_fatal, arg_max(text, line) FILTER (trim(text) <> '') AS last FROM lg GROUP BY user_id)
SELECT user_id, n_fatal, CASE WHEN n_fatal > 0 THEN 'failed' WHEN last IS NULL THEN 'empty' WHEN ends_with(rtrim(last), 'End') THEN 'completed' ELSE 'incomplete' END AS status FROM s""")
def q54(spark: SparkSession, d: str) -> DataFrame:
    return logs.run_status(log_lines(spark, d), "user_id", log_rules.FATAL)


@query("q55_health", """SELECT user_id, event_type AS field, min(value) AS least, max(value) AS greatest, min(value) <= 0 AS nonpositive, event_type IN ('view', 'click') AND (min(value) < 0 OR max(value) > 1) AS outside FROM events GROUP BY user_id, event_type""")
def q55(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "events").select("user_id", F.col("event_type").alias("field"), "value")
    return logs.health(values, ["user_id", "field"], "value", ("view", "click"))


@query("q49_impulse", """WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, max(value - 100) AS p FROM events GROUP BY ALL),
a AS (SELECT *, (greatest(p, 0) + lag(greatest(p, 0)) OVER w) / 2 * (t - lag(t) OVER w) AS area FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, max(p) AS peak, arg_max(t, (p, -t)) AS t_peak, round(coalesce(sum(area), 0), 6) AS impulse FROM a GROUP BY user_id""")
def q49(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    series = table(spark, d, "events").groupBy("user_id", t.alias("t")).agg(F.max(F.col("value") - 100).alias("p"))
    return logs.impulse(series, "user_id")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    rater = lambda c, k: F.when(F.col("doc_id") % 17 == k, None).otherwise(((F.col(c) * 2 + F.col("doc_id") % 3) % 5) / 4.0)
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "source", "lang", rater("quality", 3).alias("left"), rater("toxic", 5).alias("right"))


_LEVELS = """levels AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 17 <> 3 THEN ((quality * 2 + doc_id % 3) % 5) / 4.0::DOUBLE END AS "left", CASE WHEN doc_id % 17 <> 5 THEN ((toxic * 2 + doc_id % 3) % 5) / 4.0::DOUBLE END AS "right" FROM labels JOIN documents USING (doc_id))"""


@query("q31_agreement", f"""WITH {_LEVELS}, k AS (SELECT "left" AS x, "right" AS y FROM levels WHERE "left" IS NOT NULL AND "right" IS NOT NULL),
e AS (SELECT sum(a.n * b.n * (a.x - b.y) ** 2) / (SELECT count(*) ** 2 FROM k) AS expected FROM (SELECT x, count(*) AS n FROM k GROUP BY x) a CROSS JOIN (SELECT y, count(*) AS n FROM k GROUP BY y) b)
SELECT count(*) AS n, (SELECT count(*) FROM levels) - count(*) AS unknown_pairs, round(avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(abs(y - x)), 6) AS mae, round(avg(y - x), 6) AS bias, max(abs(y - x)) AS max_difference, round(1 - avg((x - y) ** 2) / any_value(expected), 6) AS quadratic_kappa FROM k CROSS JOIN e""")
def q31(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.agreement(_levels(spark, d))


@query("q30_confusion", f'WITH {_LEVELS} SELECT "left", "right", count(*) AS n FROM levels WHERE "left" IS NOT NULL AND "right" IS NOT NULL GROUP BY ALL')
def q30(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_levels(spark, d))


@query("q32_comparison", f"""WITH {_LEVELS} SELECT source, count(*) AS n, count(d) AS identified, round(avg(abs(d)), 6) AS mae, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rmse,
round(count(*) FILTER (abs(d) <= 25) / nullif(count(d), 0), 6) AS within_identified, round(count(*) FILTER (abs(d) <= 25) / count(*), 6) AS within_all, round(sum(coalesce(abs(d), 0)) / count(*), 6) AS mae_low,
round(sum(CASE WHEN d IS NOT NULL THEN abs(d) WHEN coalesce(l, r) IS NULL THEN 100 ELSE greatest(coalesce(l, r), 100 - coalesce(l, r)) END) / count(*), 6) AS mae_high
FROM (SELECT source, 100 * "left" AS l, 100 * "right" AS r, 100 * "right" - 100 * "left" AS d FROM levels) GROUP BY source""")
def q32(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.comparison(_levels(spark, d).select("source", (100 * F.col("left")).alias("left"), (100 * F.col("right")).alias("right")), "source")


@query("q33_composite", f"""WITH {_LEVELS}, s AS (SELECT doc_id, ["left", "right", 1.0::DOUBLE] AS points, "left" AS f, "right" AS a, doc_id % 2 = 0 AS conditional, doc_id % 13 = 0 AS failed FROM levels),
b AS (SELECT *, list_sum(list_transform(points, lambda x: coalesce(x, 0))) / 3 AS k0, list_sum(list_transform(points, lambda x: coalesce(x, 1))) / 3 AS k1, coalesce(f, 0) AS f0, coalesce(f, 1) AS f1, coalesce(a, 0) AS a0, coalesce(a, 1) AS a1 FROM s),
v AS (SELECT doc_id, failed, (len(list_filter(points, lambda x: x IS NULL)) > 0 OR f IS NULL OR (conditional AND a IS NULL)) AS unk,
 CASE WHEN failed THEN 0 WHEN conditional THEN round(100 * (k0 + f0 + a0) / 3, 6) ELSE round(100 * (k0 + f0) / 2, 6) END AS al, CASE WHEN failed THEN 0 WHEN conditional THEN round(100 * (k1 + f1 + a1) / 3, 6) ELSE round(100 * (k1 + f1) / 2, 6) END AS ah,
 CASE WHEN failed THEN 0 WHEN conditional THEN round(100 * (k0 * f0 * a0) ** (1 / 3.0::DOUBLE), 6) ELSE round(100 * sqrt(k0 * f0), 6) END AS gl, CASE WHEN failed THEN 0 WHEN conditional THEN round(100 * (k1 * f1 * a1) ** (1 / 3.0::DOUBLE), 6) ELSE round(100 * sqrt(k1 * f1), 6) END AS gh,
 CASE WHEN failed THEN 0.0 WHEN k0 = 1 AND f0 = 1 AND (NOT conditional OR a0 = 1) THEN 1.0 ELSE 0.0 END AS sl, CASE WHEN failed THEN 0.0 WHEN k1 = 1 AND f1 = 1 AND (NOT conditional OR a1 = 1) THEN 1.0 ELSE 0.0 END AS sh FROM b)
SELECT doc_id, CAST(CASE WHEN NOT unk OR failed THEN al END AS DOUBLE) AS arith, CAST(CASE WHEN NOT unk OR failed THEN gl END AS DOUBLE) AS geo, CAST(CASE WHEN sl = sh THEN sl END AS DOUBLE) AS strict, CAST(al AS DOUBLE) AS arith_low, CAST(ah AS DOUBLE) AS arith_high, CAST(gl AS DOUBLE) AS geo_low, CAST(gh AS DOUBLE) AS geo_high FROM v""")
def q33(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = _levels(spark, d).select("doc_id", F.array("left", "right", F.lit(1.0)).alias("points"), F.col("left").alias("f"), F.col("right").alias("a"), (i % 2 == 0).alias("conditional"), (i % 13 == 0).alias("failed"))
    return evaluation.composite(rows).select("doc_id", "arith", "geo", "strict", "arith_low", "arith_high", "geo_low", "geo_high")


@query("q34_bootstrap")
def q34(spark: SparkSession, d: str) -> DataFrame:
    """Intervals by resampling sources; the draws come from a generator that SQL doesn't have."""
    values = _levels(spark, d).where("left is not null and right is not null").select("source", (F.col("right") - F.col("left")).alias("v"))
    n = values.select("source").distinct().count()
    return evaluation.cluster_bootstrap(values, "source", "v", evaluation.resamples(spark, n))


@query("q35_stratified", "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('panel:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 15")
def q35(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stratified(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 15, "panel").select("lang", "doc_id", F.col("place").cast("long").alias("place"))


@query("q36_grading", """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'single' WHEN turn % 3 = 1 THEN 'judge' ELSE 'fill' END AS kind, CASE conv_id % 5 WHEN 0 THEN 'in_flight' WHEN 1 THEN 'failed' ELSE 'answered' END AS status,
 (['A', 'true', 'xyz'])[turn % 3 + 1] AS gold, CASE WHEN conv_id % 4 = 3 THEN text ELSE 'because' || chr(10) || 'FINAL: ' || (['A', 'B', 'true', 'xyz', 'no way'])[(conv_id + turn) % 5 + 1] END AS answer, conv_id % 4 = 3 AS bare, (['A', 'B', 'true', 'xyz', 'no way'])[(conv_id + turn) % 5 + 1] AS v FROM conversations),
g AS (SELECT *, status = 'answered' AND NOT bare AND CASE kind WHEN 'single' THEN regexp_matches(v, '^[ABCD]$') WHEN 'judge' THEN v IN ('true', 'false') ELSE regexp_matches(v, '^[-A-Za-z0-9_.<>]+$') END AS valid FROM a)
SELECT conv_id, turn, valid AS format_valid, CAST(CASE WHEN status <> 'in_flight' THEN CASE WHEN valid AND v = gold THEN 1 ELSE 0 END END AS INTEGER) AS score,
 CASE WHEN status = 'in_flight' THEN 'not_run_or_outcome_unknown' WHEN status <> 'answered' THEN 'generation_failed' WHEN bare THEN 'missing_or_multiple_final_marker' WHEN valid AND v = gold THEN 'correct' WHEN valid THEN 'wrong_answer' ELSE 'invalid_final_format' END AS reason FROM g""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    rows = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        pick(("single", "judge", "fill"), t % 3).alias("kind"),
        F.when(c % 5 == 0, "in_flight").when(c % 5 == 1, "failed").otherwise("answered").alias("status"),
        pick(("A", "true", "xyz"), t % 3).alias("gold"),
        F.when(c % 4 == 3, F.col("text")).otherwise(F.concat(F.lit("because\nFINAL: "), pick(("A", "B", "true", "xyz", "no way"), (c + t) % 5))).alias("answer"),
    )
    return evaluation.grade(rows).select("conv_id", "turn", "format_valid", "score", "reason")


@query("q40_regroup", "SELECT c_custkey, count(*) AS n_orders, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey)) AS orders_sha256 FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def q40(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return held.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("orders_sha256"))


@query("q41_benchmark_summary", "SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 6) AS pass_rate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderpriority")
def q41(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    g = table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").groupBy(F.col("o_orderpriority").alias("category"))
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return g.agg(F.count("*").alias("n"), is_("F").alias("finished"), is_("O").alias("open"), F.round(is_("F") / F.nullif(F.count("*"), F.lit(0)), 6).alias("pass_rate"))


@query("q42_usage", "SELECT event_type, 'k' AS key, count(*) AS n, sum(CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT)) AS total FROM events WHERE regexp_matches(props, '\"k\": *-?[0-9]+') GROUP BY event_type")
def q42(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    numbers = members.withColumn("value", F.col("value").try_cast("long")).where("value is not null")
    return numbers.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("q43_pending", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q43(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


METHODS, BUDGETS = ("graph", "bm25", "dense", "hybrid"), ("S", "M", "L")


@query("q44_task_matrix", f"SELECT item_id, m AS method, b AS budget, sha256('{{\"item_id\":' || item_id || ',\"method\":\"' || m || '\",\"budget\":\"' || b || '\"}}') AS task_id FROM benchmark, (SELECT unnest({list(METHODS)}) AS m), (SELECT unnest({list(BUDGETS)}) AS b)")
def q44(spark: SparkSession, d: str) -> DataFrame:
    each = lambda c: F.explode(F.array(*map(F.lit, c)))
    tasks = table(spark, d, "benchmark").select("item_id", each(METHODS).alias("method")).select("*", each(BUDGETS).alias("budget"))
    return tasks.withColumn("task_id", T.canonical_hash(F.col("item_id"), F.col("method"), F.col("budget")))


@query("q45_panels", "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY sha256('slot:' || doc_id), doc_id) - 1) % 3 AS panel FROM documents")
def q45(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", evaluation.hash_order("slot", F.col("doc_id")).alias("h"))
    return ranges.numbered(docs, ["h", "doc_id"], ["lang"]).select("doc_id", "lang", F.pmod(F.col("place") - 1, F.lit(3)).cast("long").alias("panel"))


@query("q46_status_counts", "SELECT user_id, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def q46(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k).alias(k)
    return table(spark, d, "events").groupBy("user_id").agg(*map(kind, ("error", "signup", "purchase")))


@query("q53_tiers", """WITH t AS (SELECT hour(ts) AS tier, value, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY hour(ts) ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY hour(ts)) AS n FROM events),
s AS (SELECT tier, count(*) AS n, count(*) FILTER (ok) AS successful, round(sum(value) / 3600, 6) AS rate, median(value) AS median_value, max(CASE WHEN k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END) AS p95 FROM t GROUP BY tier)
SELECT *, tier = (SELECT arg_max(tier, (rate, -tier)) FROM s) AS chosen FROM s""")
def q53(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.hour("ts").cast("long").alias("tier"), "value", (F.col("event_type") != "error").alias("ok"))
    # values are counted first, so a tier's window has one row for each distinct value
    each = rows.groupBy("tier", "value").agg(F.count("*").alias("m"), F.count_if("ok").alias("good"))
    order = Window.partitionBy("tier").orderBy("value")
    placed = each.withColumns({"upto": F.sum("m").over(order), "n": F.sum("m").over(Window.partitionBy("tier"))})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    tiers = placed.groupBy("tier").agg(
        F.sum("m").alias("n"),
        F.sum("good").alias("successful"),
        F.round(F.sum(F.col("value") * F.col("m")) / 3600, 6).alias("rate"),
        middle.alias("median_value"),
        # nearest rank: the value at floor(0.95 n) in order
        at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95"),
    )
    best = tiers.agg(F.max_by("tier", F.struct("rate", -F.col("tier"))).alias("best"))
    return tiers.join(F.broadcast(best)).withColumn("chosen", F.col("tier") == F.col("best")).drop("best")  # one row


@query("q50_progress", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q50(spark: SparkSession, d: str) -> DataFrame:
    """A stream that reads what is there and ends; its counts are the batch's."""
    return _stream(spark, d, lambda e: streams.progress(e, ["event_type"]), "complete")


@query("q51_paired", "SELECT a.user_id * 1000000 + a.k AS task, (a.value + b.value) / 2 AS mean FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value, event_id FROM events WHERE event_type = 'click') a JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.k = b.k")
def q51(spark: SparkSession, d: str) -> DataFrame:
    """The pairing of two judges' results over what has come so far."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "value", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    side = lambda k: e.where(F.col("event_type") == k).select((F.col("user_id") * 1_000_000 + F.row_number().over(order)).alias("task"), "ts", "value")
    return streams.paired(side("click"), side("view"), "task", within="400 days")


_STOP_SQL = f"""WITH lg AS (SELECT user_id, event_id AS seq, value AS seconds, {_SAID_SQL} AS text FROM events),
m AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)\\b(?:nan|[+-]?inf(?:inity)?)\\b|FOAM FATAL|segmentation fault') THEN 'nonfinite_or_fatal' WHEN TRY_CAST(regexp_extract(text, 'min\\(T\\): *([-+0-9.eE]+)', 1) AS DOUBLE) <= 0 THEN 'nonpositive_temperature'
  WHEN sum(seconds) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) > 500 THEN 'budget_exceeded' END AS kind FROM lg)
SELECT user_id, min(seq) AS seq, arg_min(kind, seq) AS kind FROM m WHERE kind IS NOT NULL GROUP BY user_id"""


@query("q52_guarded_log", _STOP_SQL)
def q52(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's log stops, by a stream with state."""

    def follow(e: DataFrame) -> DataFrame:
        return streams.guarded(e.select("user_id", F.col("event_id").alias("seq"), F.col("value").alias("seconds"), said().alias("text")), "user_id", 500.0)

    return _stream(spark, d, follow, "append")


def _stream(spark: SparkSession, d: str, plan, mode: str) -> DataFrame:
    """Run ``plan`` over the events as a stream until all is read; returns what the sink has."""
    import uuid

    from tessera.session import shared_dir

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"{at}/out"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    plan(rows).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    found = spark.read.parquet(out)
    return found.drop("batch") if mode == "append" else found
