"""Queries of selections, sets, ledgers, ranking quality and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, ledgers, ranges, ranking, selection
from tessera.plans.common import CASE_FILES_SQL, HITS_SQL, PASSAGES_SQL, case_files, item_hits, table, texts
from tessera.plans.retrieval import _DENSE_SQL, _dense

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


_LEDGER = """a AS (SELECT user_id AS request, event_id AS seq, CASE event_type WHEN 'error' THEN 'http_rejected' WHEN 'view' THEN 'connection_error' WHEN 'click' THEN 'in_flight' ELSE 'complete' END AS status, CAST(floor(value) AS BIGINT) % 3 AS cost FROM events)"""


@query("q57_retry_ledger", f"""WITH {_LEDGER}, s AS (SELECT request, count(*) AS n_attempts, CAST(sum(CASE WHEN status = 'in_flight' THEN 1 ELSE coalesce(cost, 0) END) AS BIGINT) AS spent,
 min(seq) FILTER (status NOT IN ('connection_error', 'in_flight')) AS done, arg_min(status, seq) FILTER (status NOT IN ('connection_error', 'in_flight')) AS final_status, max(seq) AS latest FROM a GROUP BY request)
SELECT request, n_attempts, spent, final_status, final_status IS NULL AND spent >= 3 AS exhausted, coalesce(done = latest, true) AS in_order FROM s""")
def q57(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "error", "http_rejected").when(t == "view", "connection_error").when(t == "click", "in_flight").otherwise("complete")
    rows = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), status.alias("status"), (F.floor("value").cast("long") % 3).alias("cost"))
    return ledgers.ledger(rows, "request", "seq", F.col("status").isin("connection_error", "in_flight")).select("request", "n_attempts", *long("spent"), "final_status", "exhausted", "in_order")


@query("q58_catalog", "SELECT page_id, path, place, CASE WHEN place % 50 = 0 AND place < count(*) OVER () THEN place END AS next_offset FROM (SELECT page_id, url AS path, row_number() OVER (ORDER BY url, page_id) AS place FROM pages WHERE contains(lower(url), lower('/EN/')))")
def q58(spark: SparkSession, d: str) -> DataFrame:
    """Paths that hold a text in any case, with the offsets at which pages end."""
    found = table(spark, d, "pages").select("page_id", F.col("url").alias("path")).where(F.contains(F.lower("path"), F.lit("/EN/".lower())))
    numbered = ranges.numbered(found, ["path", "page_id"])
    n = found.count()
    return numbered.withColumn("next_offset", F.when((F.col("place") % 50 == 0) & (F.col("place") < n), F.col("place")))


@query("q59_fixed_grep", r"""WITH t AS (SELECT item_id, text, regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_.-]*|[\x{4e00}-\x{9fff}]{2,}') AS w FROM benchmark)
SELECT item_id, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: regexp_replace(x, '([^A-Za-z0-9_\x{4e00}-\x{9fff}])', '\\\1', 'g')), '|') ELSE regexp_replace(coalesce(text, ''), '([^A-Za-z0-9_\x{4e00}-\x{9fff}])', '\\\1', 'g') END AS pattern FROM t""")
def q59(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.alternation(F.col("text")).alias("pattern"))


WITHOUT = ["the", "of", "and", "der", "la", "de"]


@query("q60_identifiers", f"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_./<>+-]*'))) AS BIGINT) AS n_literals,
 sha256(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)), lambda x: NOT list_contains({WITHOUT}, x)))), ' ')) AS identifiers_sha256 FROM documents""")
def q60(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, d).select("doc_id", F.size(T.literals(t)).cast("long").alias("n_literals"), F.sha2(F.array_join(T.identifiers(t, WITHOUT), " ").cast("binary"), 256).alias("identifiers_sha256"))


def _reasons_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    bare = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
    checks = [f"CASE WHEN {bare} = '' THEN {quoted(T.REPORT_EMPTY)} END"]
    for pattern, stripped, why in T.REPORT_ERRORS:
        seen = bare if stripped else "coalesce(text, '')"
        checks.append(f"CASE WHEN regexp_matches({seen}, {quoted(pattern)}) THEN {quoted(why)} END")
    checks.append(f"CASE WHEN length({bare}) < 80 THEN {quoted('report ' + T.REPORT_SHORT)} END")
    return f"array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), '; ')"


@query("q61_report_reasons", f"SELECT conv_id, turn, {_reasons_sql()} AS reasons FROM conversations")
def q61(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.report_reasons(F.col("text"), "report"), "; ").alias("reasons"))


FOLDERS, FILES = ["0", "1.5", "postProcessing"], ["README", "README.md", "Allrun", "Allclean"]


@query("q62_case_directory", f"""WITH {CASE_FILES_SQL}, p AS (SELECT path, string_split(path, '/') AS x FROM files),
m AS (SELECT path, x, list_min(list_filter(range(1, len(x) + 1), lambda i: list_contains({FOLDERS}, x[i]) AND i > 3)) AS i FROM p)
SELECT path, CASE WHEN x[1] = 'ASIA' THEN CASE WHEN i IS NOT NULL THEN array_to_string(x[1:i - 1], '/') WHEN list_contains({FILES}, x[len(x)]) THEN array_to_string(x[1:len(x) - 1], '/') END END AS "case" FROM m""")
def q62(spark: SparkSession, d: str) -> DataFrame:
    return case_files(spark, d).select("path", T.case_directory(F.col("path"), "ASIA", FOLDERS, FILES).alias("case"))


def _panels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 3).alias("panel"), "quality", "toxic")


@query("q63_balance", "SELECT panel, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_cells, count(*) FILTER (n > 2) AS n_crowded FROM (SELECT doc_id % 3 AS panel, quality, toxic, count(*) AS n FROM labels GROUP BY ALL) GROUP BY panel")
def q63(spark: SparkSession, d: str) -> DataFrame:
    return selection.balance(_panels(spark, d), "panel", ["quality", "toxic"], 2)


@query("q64_set_checks", """WITH l AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0),
c AS (SELECT count(*) FILTER (r.doc_id IS NULL) AS only_left, count(*) FILTER (l.doc_id IS NULL) AS only_right, count(*) FILTER (l.doc_id = r.doc_id) AS "both" FROM l FULL JOIN r ON l.doc_id = r.doc_id)
SELECT *, only_left = 0 AND only_right = 0 AS same, "both" = 0 AS disjoint FROM c""")
def q64(spark: SparkSession, d: str) -> DataFrame:
    return selection.compared(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id"))


@query("q65_higher_score", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL}, {_DENSE_SQL}
SELECT item_id, doc_id, max(score) AS score FROM (SELECT item_id, doc_id, score FROM hits UNION ALL SELECT item_id, doc_id, score FROM dense) GROUP BY ALL""")
def q65(spark: SparkSession, d: str) -> DataFrame:
    return selection.higher(item_hits(spark, d), _dense(spark, d), ["item_id", "doc_id"])


@query("q66_orders_by_keys", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey DESC) AS by_tuple FROM orders""")
def q66(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    one = selection.placed(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")])
    two = selection.placed(one, ["o_custkey"], [F.desc("o_orderpriority"), F.desc("o_totalprice"), F.desc("o_orderkey")], "by_tuple")
    return two.select("o_orderkey", *long("place", "by_tuple"))


@query("q67_costs", """WITH a AS (SELECT event_type AS stage, user_id * 10 + event_id % 7 AS attempt, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 100 AS BIGINT) END AS tokens, CASE WHEN user_id % 4 <> 1 THEN event_id % 10 END AS price FROM events),
o AS (SELECT stage, attempt, count(*) AS n, max(tokens) AS tokens, max(price) AS price FROM a GROUP BY ALL)
SELECT stage, count(*) AS n_attempts, CAST(sum(n - 1) AS BIGINT) AS inherited, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (tokens IS NULL) AS unknown_tokens, count(price) AS priced, count(*) FILTER (price IS NULL) AS unpriced, CAST(sum(price) AS BIGINT) AS price FROM o GROUP BY stage""")
def q67(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), (u * 10 + e % 7).alias("attempt"), F.when(e % 5 != 0, e % 100).alias("tokens"), F.when(u % 4 != 1, e % 10).alias("price"))
    return ledgers.costs(rows, "stage", "attempt").withColumn("price", F.col("price").cast("long"))


@query("q68_checked_labels", """SELECT l.doc_id, CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN sha256(coalesce(p.text, '')) = CASE WHEN l.doc_id % 10 = 0 THEN 'other' ELSE sha256(coalesce(p.text, '')) END THEN 'matched' ELSE 'changed' END AS state
FROM labels l LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0) p USING (doc_id)""")
def q68(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d).select("doc_id", "text")
    said = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "other").otherwise(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha256"))
    labels = table(spark, d, "labels").select("doc_id").join(said, "doc_id")
    return ledgers.hash_checked(labels, docs.where("doc_id % 7 <> 0"), "doc_id").select("doc_id", "state")


@query("q69_retrieval_quality", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL}, {_DENSE_SQL},
g AS (SELECT DISTINCT item_id, doc_id FROM dense WHERE rank <= 20), f AS (SELECT item_id, doc_id, min(rank) AS rank FROM hits GROUP BY ALL)
SELECT item_id, count(*) AS n_gold, round(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank FROM g LEFT JOIN f USING (item_id, doc_id) GROUP BY item_id""")
def q69(spark: SparkSession, d: str) -> DataFrame:
    gold = _dense(spark, d).where("rank <= 20").select("item_id", "doc_id")
    return ledgers.retrieval_quality(item_hits(spark, d), gold, "item_id", "doc_id")


@query("q70_paired_arms", """WITH e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id)
SELECT count(b - a) AS n, count(*) FILTER (b - a > 0) AS wins, count(*) FILTER (b - a = 0) AS ties, count(*) FILTER (b - a < 0) AS losses, round(avg(b - a), 6) AS mean_difference, count(*) FILTER (b - a IS NULL) AS unpaired FROM e""")
def q70(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "value")
    return ledgers.paired_arms(rows, "user_id", "event_type", "click", "view", "value")


@query("q71_leakage", "SELECT family, count(DISTINCT doc_id % 4) AS n_splits, count(*) AS n_rows FROM (SELECT sha256(coalesce(text, '')) AS family, doc_id FROM documents) GROUP BY family HAVING count(DISTINCT doc_id % 4) > 1")
def q71(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("family"), (F.col("doc_id") % 4).alias("split"))
    return ledgers.leakage(rows, "family", "split")


@query("q72_chosen", "SELECT c_custkey, place, c_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) JOIN customer USING (c_custkey) WHERE place <= 20")
def q72(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    best = customers.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    return selection.chosen(selection.allowed(customers, ["c_custkey", "c_name"]), best.withColumn("place", place), "c_custkey", "place", 20).select("c_custkey", *long("place"), "c_name")


@query("q73_boilerplate", f"WITH RECURSIVE {PASSAGES_SQL} SELECT passage_id FROM passages WHERE NOT (starts_with(text, 'THE') OR regexp_full_match(trim(text), '(?i)(?:table of )?contents|目录'))")
def q73(spark: SparkSession, d: str) -> DataFrame:
    return ranking.passages(texts(spark, d)).where(~selection.boilerplate(F.col("text"), header="THE")).select("passage_id")


@query("q74_session_budget", """WITH c AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS chars, row_number() OVER w AS call, least(CAST(floor(value) AS BIGINT), 120) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, coalesce(sum(CASE WHEN call <= 12 THEN a END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT user_id, event_id, call, CAST(CASE WHEN call <= 12 THEN least(a, greatest(600 - before, 0)) ELSE 0 END AS BIGINT) AS delivered FROM b""")
def q74(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("chars"))
    return ledgers.session_budget(calls, "user_id", "event_id", max_call=120, max_total=600).select("user_id", "event_id", *long("call", "delivered"))


@query("q75_two_judges", "WITH s AS (SELECT user_id, event_type, CASE WHEN max(event_id) % 9 <> 0 THEN max(value) END AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) SELECT user_id, CASE WHEN count(v) = 2 THEN round(avg(v), 6) END AS mean FROM s GROUP BY user_id HAVING count(*) = 2")
def q75(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.max("event_id") % 9 != 0, F.max("value"))
    judged = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(value.alias("v"))
    return evaluation.two_judges(judged, "user_id", "event_type", "v")


@query("q76_text_rules", r"""SELECT doc_id, substring(sha1(doc_id || chr(10) || source), 1, 16) AS short_id, ends_with(rtrim(coalesce(text, '')), 'End') OR contains(coalesce(text, ''), chr(10) || 'End' || chr(10)) AS clean,
 sha256(CASE WHEN length(coalesce(text, '')) <= 300 THEN coalesce(text, '') ELSE text[:200] || chr(10) || '...' || chr(10) || right(text, 100) END) AS compacted_sha256 FROM documents""")
def q76(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, d).select("doc_id", T.short_id(F.col("doc_id").cast("string"), F.col("source")).alias("short_id"), T.clean_end(t).alias("clean"), F.sha2(T.compacted(t, 200, 100).cast("binary"), 256).alias("compacted_sha256"))


@query("q77_code_text", r"""SELECT page_id, sha256(array_to_string(list_filter(regexp_extract_all(coalesce(html, ''), '(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\]|\\.)*"|[^/"]+|.'), lambda x: NOT (starts_with(x, '/*') OR starts_with(x, '//'))), '')) AS bare_sha256, CASE WHEN regexp_extract(coalesce(html, ''), '(?m)^\s*font\s+([^;]+);', 1) <> '' THEN trim(regexp_extract(coalesce(html, ''), '(?m)^\s*font\s+([^;]+);', 1)) END AS font FROM pages""")
def q77(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.sha2(T.without_comments(h).cast("binary"), 256).alias("bare_sha256"), T.entry(h, "font").alias("font"))


@query("q78_smallest_parent", f"""WITH RECURSIVE {PASSAGES_SQL}, a AS (SELECT doc_id, doc_id % 13 + 1 AS "start", doc_id % 13 + 1 + doc_id % 5 AS "end" FROM documents),
j AS (SELECT a.doc_id, p."start" AS s, p."end" AS e, p."end" - p."start" AS n FROM a JOIN passages p ON a.doc_id = p.doc_id AND p."start" <= a."start" AND a."end" <= p."end" AND length(p.text) <= 1200)
SELECT doc_id, "start", "end", CAST(p_start AS BIGINT) AS p_start, CAST(p_end AS BIGINT) AS p_end FROM a LEFT JOIN (SELECT doc_id, arg_min(s, (n, s, e)) AS p_start, arg_min(e, (n, s, e)) AS p_end FROM j GROUP BY doc_id) USING (doc_id)""")
def q78(spark: SparkSession, d: str) -> DataFrame:
    docs, i = texts(spark, d), F.col("doc_id")
    inner = docs.select("doc_id", (i % 13 + 1).alias("start"), (i % 13 + 1 + i % 5).alias("end"))
    outer = ranking.passages(docs).select("doc_id", *[F.col(a).cast("long").alias(f"p_{a}") for a in ("start", "end")], F.length("text").alias("p_chars"))
    return ranges.smallest_parent(inner.withColumn("key", i), outer, "key", "doc_id").drop("key")


@query("q79_undelivered", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL},
wanted AS (SELECT DISTINCT item_id, doc_id, unnest(range("start", "end" + 1)) AS line FROM hits WHERE rank <= 5), had AS (SELECT DISTINCT item_id, doc_id, unnest(range("start", "end" + 1)) AS line FROM hits WHERE rank <= 3)
SELECT item_id, doc_id, CAST(line AS BIGINT) AS line FROM wanted ANTI JOIN had USING (item_id, doc_id, line)""")
def q79(spark: SparkSession, d: str) -> DataFrame:
    hits = item_hits(spark, d, 5)
    return ranges.undelivered(hits, hits.where("rank <= 3"), ["item_id", "doc_id"]).select("item_id", "doc_id", *long("line"))


@query("q80_inventory", f"""WITH {CASE_FILES_SQL}, f AS (SELECT regexp_extract(path, '^[^/]+/[^/]+', 0) AS "case", path, size FROM files WHERE contains(path, '/postProcessing/'))
SELECT "case", path, size, truncated, place FROM (SELECT *, count(*) OVER (PARTITION BY "case") >= 80 AS truncated, row_number() OVER (PARTITION BY "case" ORDER BY path) AS place FROM f) WHERE place <= 80""")
def q80(spark: SparkSession, d: str) -> DataFrame:
    files = case_files(spark, d).where(F.contains("path", F.lit("/postProcessing/"))).select(F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("case"), "path", "size")
    return selection.inventory(files, "case").select("case", "path", "size", "truncated", *long("place"))


@query("q81_tier_stop", """WITH t AS (SELECT hour(ts) AS tier, round(sum(value) / 3600, 6) AS rate FROM events GROUP BY ALL),
b AS (SELECT *, coalesce(rate > max(rate) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * 1.03, true) AS better FROM t),
l AS (SELECT *, sum(CASE WHEN better THEN 0 ELSE 1 END) OVER (ORDER BY tier ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS late FROM b)
SELECT tier, rate, better FROM (SELECT *, coalesce(bool_or(late) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM l) WHERE NOT stopped""")
def q81(spark: SparkSession, d: str) -> DataFrame:
    tiers = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("tier")).agg(F.round(F.sum("value") / 3600, 6).alias("rate"))
    return selection.tier_stop(tiers, "tier", "rate")


@query("q82_checks", """WITH c AS (SELECT o_orderkey, [CASE WHEN NOT o_totalprice > 50000 THEN 'priced' END, CASE WHEN NOT o_orderstatus = 'F' THEN 'finished' END, CASE WHEN NOT starts_with(o_orderpriority, '1') THEN 'urgent' END] AS x FROM orders),
i AS (SELECT o_orderkey, list_filter(x, lambda v: v IS NOT NULL) AS issues FROM c)
SELECT o_orderkey, array_to_string(issues, ',') AS issues, NOT list_has_any(issues, ['priced', 'finished']) AS passed FROM i""")
def q82(spark: SparkSession, d: str) -> DataFrame:
    rules = {"priced": F.col("o_totalprice") > 50000, "finished": F.col("o_orderstatus") == "F", "urgent": F.startswith(F.col("o_orderpriority"), F.lit("1"))}
    return selection.checked(table(spark, d, "orders"), rules, ["priced", "finished"]).select("o_orderkey", F.array_join("issues", ",").alias("issues"), "passed")


@query("q83_conditions", """WITH c AS (SELECT p_partkey, p_size = 10 + p_partkey % 5 AS size_is, CASE WHEN p_partkey % 3 <> 0 THEN p_brand = 'Brand#13' END AS brand_is FROM part)
SELECT p_partkey, CASE WHEN NOT size_is OR NOT brand_is THEN false WHEN brand_is IS NULL THEN NULL ELSE true END AS truth, CASE WHEN brand_is IS NULL THEN 'brand' ELSE '' END AS missing FROM c""")
def q83(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.array(one("size", 10 + k % 5), one("brand", F.lit("Brand#13"))).alias("wanted"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.when(k % 3 != 0, F.col("p_brand"))).alias("context"),
    )
    return selection.conditions(rows, "wanted", "context").select("p_partkey", "truth", F.array_join("missing", ",").alias("missing"))


@query("q84_diff_files", """WITH l AS (SELECT user_id, event_id AS line, CASE event_type WHEN 'error' THEN 'diff --git a/.env b/.env' WHEN 'signup' THEN 'diff --git a/x.txt b/x.txt' ELSE '+' || event_type END AS text FROM events),
h AS (SELECT *, last_value(CASE WHEN starts_with(text, 'diff --git ') THEN contains(text, '.env') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line) AS hidden FROM l)
SELECT user_id, line, text FROM h WHERE NOT coalesce(hidden, false)""")
def q84(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    said = F.when(t == "error", "diff --git a/.env b/.env").when(t == "signup", "diff --git a/x.txt b/x.txt").otherwise(F.concat(F.lit("+"), t))
    return selection.without_sensitive_files(table(spark, d, "events").select("user_id", F.col("event_id").alias("line"), said.alias("text")), "user_id", T.sensitive_path)


IMPORTANT = r"\b(type|font|div|license|token)\b"


@query("q85_important_lines", rf"""WITH l AS (SELECT page_id, coalesce(html, '') AS t, string_split(CASE WHEN ends_with(html, chr(10)) THEN html[:-2] ELSE coalesce(html, '') END, chr(10)) AS x FROM pages),
f AS (SELECT page_id, t, list_filter(list_transform(list_filter(x, lambda v: regexp_matches(v, '{IMPORTANT}')), lambda v: regexp_replace(v, '\s+$', '')), lambda v: v <> '') AS y FROM l),
j AS (SELECT page_id, t, regexp_replace(array_to_string(list_filter(y, lambda v, i: list_position(y, v) = i), chr(10)), '^\s+|\s+$', '', 'g') AS j FROM f)
SELECT page_id, sha256(CASE WHEN length(j) > 200 AND j[201] <> chr(10) THEN regexp_replace(j[:200], '\s+$', '') || chr(10) || '... [excerpt truncated]' WHEN j <> '' THEN j[:200] ELSE regexp_replace(t[:200], '^\s+|\s+$', '', 'g') END) AS excerpt_sha256 FROM j""")
def q85(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(T.important_lines(F.col("html"), IMPORTANT, 200).cast("binary"), 256).alias("excerpt_sha256"))
