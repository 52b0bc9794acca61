"""Queries of parameter tables, case states and targets, requirements, reviewed ways, pages, groups and case texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import case_text as C
from tessera.functions import json_text as J
from tessera.operators import cases
from tessera.plans.common import table

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


def _joined(*names: str):
    return [F.array_join(n, ",").alias(n) for n in names]


_MANUAL = r"""concat('# ', p_brand, '\n\n| Variable | Description |\n', CASE WHEN p_partkey % 3 = 0 THEN '|x|y|' ELSE '|---|:--:|' END, '\n| `p', p_partkey, '` (`q`) | Size (default is ', p_size, ') |\n| $A_s$ | Required only if active |\n\n```\n| Variable | Description |\n|---|---|\n| no | no |\n```\n')"""


@query("q109_parameter_rows", """WITH p AS (SELECT *, unnest([5, 6]) AS line FROM part WHERE p_partkey % 3 <> 0)
SELECT p_partkey, p_brand AS section, CAST(line AS BIGINT) AS line, CASE WHEN line = 5 THEN 'p' || p_partkey || ',q' ELSE 'As' END AS identifiers, CASE WHEN line = 5 THEN 'default is ' || p_size ELSE '' END AS defaults, CASE WHEN line = 6 THEN 'Required only if active' ELSE '' END AS requirements FROM p""")
def q109(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of manuals made of parts, a third of which have no valid separator."""
    manuals = table(spark, d, "part").select("p_partkey", F.expr(_MANUAL).alias("text"))
    return cases.parameter_rows(manuals, "p_partkey").select("p_partkey", "section", *_whole("line"), *_joined("identifiers", "defaults", "requirements"))


@query("q110_constant_state", """WITH r AS (SELECT o_custkey, CASE WHEN o_orderkey % 31 = 0 THEN 'sutherland' ELSE 'const' END AS kind, CASE WHEN o_orderkey % 29 = 0 THEN '$mu' WHEN o_orderkey % 7 = 0 THEN '1.8e-5' WHEN o_orderkey % 11 = 0 THEN '-2' ELSE '0.0' END AS value FROM orders),
v AS (SELECT o_custkey, CASE WHEN kind = 'const' THEN TRY_CAST(value AS DOUBLE) END AS v FROM r)
SELECT o_custkey, count(*) AS n, CASE WHEN bool_or(v IS NULL OR NOT isfinite(v)) THEN 'unknown' WHEN bool_or(v > 0) THEN 'positive_const_input' WHEN bool_or(v < 0) THEN 'negative_const_input' ELSE 'all_const_zero' END AS state FROM v GROUP BY o_custkey""")
def q110(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 29 == 0, "$mu").when(k % 7 == 0, "1.8e-5").when(k % 11 == 0, "-2").otherwise("0.0")
    rows = table(spark, d, "orders").select("o_custkey", F.when(k % 31 == 0, "sutherland").otherwise("const").alias("kind"), value.alias("value"))
    return cases.constant_state(rows, "o_custkey")


_ASKED = "CASE s_suppkey % 5 WHEN 0 THEN concat('gamma=1.', s_suppkey % 4, ' and gamma (heat ratio) is 1.', s_suppkey % 4, '0') WHEN 1 THEN 'gamma>1.4' WHEN 2 THEN 'heat ratio of 1.1; gamma=1.2' WHEN 3 THEN 'Keep gamma unchanged.' ELSE concat('gas with gamma 1.', s_suppkey % 4, '; keep heat ratio unchanged') END"


@query("q111_attribute_targets", """WITH r AS (SELECT s_suppkey, s_nationkey AS c, s_suppkey % 5 AS k, s_suppkey % 4 AS v FROM supplier WHERE s_suppkey % 5 <> 3), m AS (SELECT *, c % 4 = v AS a, c % 7 <> 0 AND c % 3 = v AS b FROM r)
SELECT s_suppkey, CASE WHEN k IN (1, 2) THEN 'unsupported_or_conflicting_predicate' WHEN c % 7 = 0 THEN 'unresolved_source' WHEN a AND b THEN 'ambiguous' WHEN a OR b THEN 'unique' ELSE 'no_match' END AS status, CASE WHEN k IN (0, 4) AND c % 7 <> 0 AND a <> b THEN CASE WHEN a THEN 'first' ELSE 'second' END END AS target FROM m""")
def q111(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c"), F.expr(_ASKED).alias("text"))
    n = F.col("n_nationkey")
    object_ = lambda t, v: F.struct(F.lit(t).alias("target"), v.alias("value"))
    seen = table(spark, d, "nation").select(n.alias("c"), F.inline(F.array(object_("first", F.concat(F.lit("1."), n % 4)), object_("second", F.when(n % 7 == 0, "$g").otherwise(F.concat(F.lit("1."), n % 3, F.lit("0")))))))
    return cases.attribute_targets(asked, seen, "s_suppkey", "c", ["gamma", "heat ratio"])


@query("q112_requirements", """WITH f AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 9 AS x FROM orders), a AS (SELECT c_custkey AS c, c_custkey % 5 AS rule FROM customer WHERE c_custkey % 5 <> 4)
SELECT a.c, rule, CAST(3 AS BIGINT) AS n_required, count(x) AS n_present, CASE WHEN rule % 2 = 0 THEN count(x) > 0 ELSE count(x) = 3 END AS met FROM a LEFT JOIN f ON a.c = f.c AND x BETWEEN rule AND rule + 2 GROUP BY a.c, rule""")
def q112(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 5).alias("rule"))
    rule = F.col("id")
    rules = spark.range(5).select(rule.alias("rule"), F.transform(F.sequence(rule, rule + 2), lambda x: F.concat(F.lit("f"), x)).alias("files"), (rule % 2 == 0).alias("any"), F.when(rule == 4, "reject").otherwise("accept").alias("review"))
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.concat(F.lit("f"), F.col("o_orderkey") % 9).alias("path"))
    return cases.requirements(asked, rules, files, "c")


@query("q113_reviewed_paths", """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation WHERE n_nationkey % 6 <> 0 UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 6 <> 0),
w AS (SELECT n_nationkey AS source, n_nationkey AS target, 0 AS hops, [n_nationkey] AS path FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT source, b, hops + 1, list_append(path, b) FROM w JOIN e ON target = a WHERE NOT list_contains(path, b))
SELECT source, target, CAST(min(hops) AS BIGINT) AS hops, array_to_string(arg_min(path, (hops, path)), ',') AS path FROM w GROUP BY source, target""")
def q113(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    edge = lambda to, kind: F.struct(to.alias("target"), F.lit(kind).alias("relation"))
    edges = table(spark, d, "nation").select(n.alias("source"), F.when(n % 6 == 0, "pending").otherwise("accept").alias("review"), F.inline(F.array(edge((n * 2 + 1) % 25, "CALL"), edge((n + 5) % 25, "CALL"), edge((n + 1) % 25, "SUMMARY"))))
    found = cases.reviewed_paths(table(spark, d, "nation").where("n_nationkey % 5 = 1").select(n.alias("source")), edges, ["CALL"])
    return found.select("source", "target", *_whole("hops"), *_joined("path"))


_LINES = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, CAST(l_quantity AS BIGINT) AS size, l_returnflag AS flag FROM lineitem)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("l_quantity").cast("long").alias("size"), F.col("l_returnflag").alias("flag"))


@query("q114_page", f"""WITH s AS (SELECT l_orderkey, place, sum(size) OVER (PARTITION BY l_orderkey ORDER BY place) AS s FROM {_LINES} WHERE place >= l_orderkey % 3)
SELECT l_orderkey, count(*) FILTER (s <= 40) AS n_items, CAST(coalesce(max(s) FILTER (s <= 40), 0) AS BIGINT) AS chars, min(place) FILTER (s > 40) AS next_offset, CASE WHEN count(*) FILTER (s <= 40) = 0 THEN 'budget_too_small_for_first_item' ELSE 'ok' END AS status FROM s GROUP BY l_orderkey""")
def q114(spark: SparkSession, d: str) -> DataFrame:
    return cases.page(_lines(spark, d), "l_orderkey", "place", "size", F.col("l_orderkey") % 3, 40)


@query("q115_atomic_groups", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY flag <> 'R', place) AS k FROM {_LINES}),
f AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS chars FROM r WHERE k = 1
 UNION ALL SELECT r.l_orderkey, r.k, CASE WHEN used + size <= 70 THEN used + size ELSE used END, CASE WHEN used + size <= 70 THEN r.place END, CASE WHEN used + size <= 70 THEN size END FROM f JOIN r ON f.l_orderkey = r.l_orderkey AND r.k = f.k + 1)
SELECT l_orderkey, place, chars FROM f WHERE place IS NOT NULL""")
def q115(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as groups of which those returned go first."""
    return cases.atomic_groups(_lines(spark, d), "l_orderkey", "place", "place", "size", 70, F.col("flag") == "R")


@query("q116_coefficients", """WITH e AS (SELECT p_partkey, unnest([{'path': 'gas/model', 'value': p_brand}, {'path': CASE WHEN p_partkey % 2 = 0 THEN 'gas/' ELSE 'other/' END || p_brand || 'Coeffs/size', 'value': CAST(p_size AS VARCHAR)}, {'path': 'gas/noneCoeffs/size', 'value': '1'}], recursive := true) FROM part),
s AS (SELECT *, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS scope FROM e)
SELECT a.p_partkey, a.path AS selector, b.path AS coefficient FROM s a JOIN s b ON a.p_partkey = b.p_partkey AND b.scope = a.scope || a.value || 'Coeffs/'""")
def q116(spark: SparkSession, d: str) -> DataFrame:
    one = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    own, k = F.concat("p_brand", F.lit("Coeffs/size")), F.col("p_partkey")
    listed = F.array(one(F.lit("gas/model"), F.col("p_brand")), one(F.concat(F.when(k % 2 == 0, "gas/").otherwise("other/"), own), F.col("p_size").cast("string")), one(F.lit("gas/noneCoeffs/size"), F.lit("1")))
    return cases.selected_coefficients(table(spark, d, "part").select("p_partkey", F.inline(listed)), "p_partkey")


@query("q117_closed", "SELECT l_partkey AS source, l_suppkey AS target, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def q117(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), "l_orderkey")
    return cases.closed(edges, table(spark, d, "part").where("p_size > 20"), "p_partkey")


@query("q118_binding", """WITH r AS (SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS a, sha256(c_name || '|' || c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '!' ELSE '' END) AS b FROM customer),
l AS (SELECT c_custkey, a FROM r WHERE c_custkey % 11 <> 0), f AS (SELECT c_custkey, b FROM r WHERE c_custkey % 7 <> 0)
SELECT c_custkey, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unbound' ELSE 'changed' END AS issue FROM l FULL JOIN f USING (c_custkey) WHERE a IS DISTINCT FROM b""")
def q118(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("c_custkey"), F.concat_ws("|", "c_name", "c_mktsegment")
    rows = table(spark, d, "customer").select("c_custkey", F.sha2(text.cast("binary"), 256).alias("sha256"), F.sha2(F.when(k % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text).cast("binary"), 256).alias("now"))
    return cases.binding(rows.where("c_custkey % 11 <> 0"), rows.where("c_custkey % 7 <> 0").select("c_custkey", F.col("now").alias("sha256")), "c_custkey")


@query("q119_benchmark_totals", """SELECT o_orderpriority, count(*) AS cases_total, count(*) FILTER (o_orderkey % 9 <> 0) AS cases_executed, count(*) FILTER (o_orderkey % 4 = 0) AS exit_code_zero, count(*) FILTER (o_orderkey % 8 = 0) AS timed_out, count(*) FILTER (o_orderkey % 3 = 0) AS physics_reports,
 count(*) FILTER (o_orderkey % 5 = 0) AS execution_reports, count(*) FILTER (o_orderstatus = 'O') AS execution_status_files, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 4 = 0) AS benchmark_passed, round(count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 4 = 0) / count(*), 6) AS benchmark_pass_rate FROM orders GROUP BY o_orderpriority""")
def q119(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", (k % 9 == 0).alias("dry_run"), (k % 4).alias("exit_code"), (k % 8 == 0).alias("timed_out"), (k % 3 == 0).alias("physics_report"), (k % 5 == 0).alias("execution_report"), (F.col("o_orderstatus") == "O").alias("execution_status"))
    return cases.benchmark_totals(runs, (F.col("o_orderstatus") == "F") & (F.col("exit_code") == 0), "o_orderpriority")


@query("q120_usage_totals", "SELECT event_type, key, count(*) AS n, round(sum(v), 4) AS total, CAST(NULL AS DOUBLE) AS cost FROM (SELECT event_type, unnest([{'key': 'value', 'v': value}, {'key': 'id', 'v': event_id}], recursive := true) FROM events) GROUP BY event_type, key")
def q120(spark: SparkSession, d: str) -> DataFrame:
    usage = F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"id":'), F.col("event_id").cast("string"), F.lit(',"cached":true,"model":"m"}'))
    return cases.usage_totals(table(spark, d, "events").select("event_type", usage.alias("usage")), "usage", "event_type").withColumns({"total": F.round("total", 4)})


_CONTROL = "concat('application  ', p_brand, ';\n', CASE WHEN p_partkey % 3 = 0 THEN 'writeInterval  0.1;\nwriteInterval 2;\n' WHEN p_partkey % 3 = 1 THEN '// ************************************************************************* //\n' ELSE '  \n' END)"


@query("q121_entries", rf"""WITH t AS (SELECT p_partkey, printf('%.10g', p_retailprice * pow(10.0, p_partkey % 23 - 9)) AS v, {_CONTROL} AS text FROM part),
u AS (SELECT *, rpad('writeInterval', 16, ' ') || v || ';' || chr(10) AS added, instr(text, '{C.CLOSING}') AS k FROM t)
SELECT p_partkey, v AS value, sha256(CASE WHEN regexp_matches(text, '(?m)^\s*writeInterval\s+[^;]+;') THEN regexp_replace(text, '(?m)(^\s*writeInterval\s+)[^;]+;', '\1' || v || ';') WHEN k > 0 THEN text[:k - 1] || added || chr(10) || text[k:] ELSE regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || added END) AS text_sha256 FROM u""")
def q121(spark: SparkSession, d: str) -> DataFrame:
    value = C.ten_digits(F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_partkey") % 23 - 9))
    rows = table(spark, d, "part").select("p_partkey", value.alias("value"), F.expr(_CONTROL).alias("text"))
    return rows.select("p_partkey", "value", F.sha2(C.with_entry(F.col("text"), "writeInterval", F.col("value")).cast("binary"), 256).alias("text_sha256"))


_SCRIPT = "concat('runApplication blockMesh\n# runApplication -s x commented\n', CASE p_partkey % 4 WHEN 0 THEN 'runApplication -s one setFields -case a\nrunParallel -parallel $(getApplication)\n' WHEN 1 THEN 'runApplication bin/solver -x\nrunApplication reconstructPar\n' WHEN 2 THEN 'runApplication $APP\n' ELSE '' END)"


@query("q122_applications", rf"""WITH t AS (SELECT p_partkey, trim(regexp_extract({_CONTROL}, '(?m)^\s*application\s+([^;]+);', 1)) AS named, regexp_replace({_SCRIPT}, '(?m)^#.*$', '', 'g') AS s FROM part),
w AS (SELECT *, list_transform(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '\brun(?:Application|Parallel)\s')), lambda x: regexp_extract(x, '\brun(?:Application|Parallel)\s+(?:-s\s+\S+\s+|-\S+\s+)*(\S+)', 1)) AS ws FROM t),
p AS (SELECT p_partkey, named, list_filter(list_transform(ws, lambda x: CASE WHEN x = '$(getApplication)' THEN named WHEN contains(x, '$') THEN NULL ELSE regexp_extract(x, '([^/]+)$', 1) END), lambda x: x IS NOT NULL AND NOT list_contains({C.UTILITIES}, x)) AS solvers FROM w)
SELECT p_partkey, coalesce(solvers[-1], named) AS application FROM p""")
def q122(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.application(F.expr(_CONTROL), F.regexp_replace(F.expr(_SCRIPT), "(?m)^#.*$", "")).alias("application"))


_BLOCKS = "concat('x { functions { no {} } }\n\nfunctions\n{\n    ', p_type, '\n    {\n        type probes;\n        inner { type a; }\n        probeLocations ( (1  ', p_size, ' 0) (0 0 0)\n (0 0 0) );\n    }\n  two\n    {\n    }\n    b', p_partkey, '\n    {}\n    c { on true; }\n}\nrest\n    {}\n boundaryField {\n    inlet {\n value 1;\n type ', p_brand, ' ; }\n    wall { }', CASE WHEN p_partkey % 3 = 0 THEN '\n    last { }\n}' WHEN p_partkey % 3 = 1 THEN '\n    more\n    {\n type x;}\n}}' ELSE '' END)"


def _block_sql(name: str) -> str:
    head = rf"regexp_extract(text, '(?m)^\s*{name}\s*\{{')"
    return f"SELECT p_partkey, '{name}' AS n, text, instr(text, {head}) AS s, instr(text, {head}) + length({head}) - 1 AS o FROM t"


@query("q123_blocks", rf"""WITH t AS (SELECT p_partkey, {_BLOCKS} AS text FROM part),
m AS ({_block_sql('functions')} UNION ALL {_block_sql('boundaryField')}),
c AS (SELECT p_partkey, n, unnest(range(o, length(text) + 1)) AS i, text, s FROM m),
d AS (SELECT *, sum(CASE WHEN text[i] = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY p_partkey, n ORDER BY i) AS depth FROM c WHERE text[i] IN ('{{', '}}')),
e AS (SELECT p_partkey, n, min(i) AS e FROM d WHERE depth = 0 GROUP BY ALL),
b AS (SELECT p_partkey, n, text[s:coalesce(e, o - 1)] AS b FROM m LEFT JOIN e USING (p_partkey, n)),
p AS (SELECT p_partkey, max(b) FILTER (n = 'functions') AS f, max(b) FILTER (n = 'boundaryField') AS b FROM b GROUP BY ALL),
k AS (SELECT p_partkey, f, b, regexp_extract_all(b, '(?m)^\s{{4,}}([A-Za-z_][A-Za-z0-9_.-]*)\s*\{{', 1) AS names FROM p)
SELECT p_partkey, array_to_string(regexp_extract_all(f, '(?m)^\s{{4,}}([A-Za-z_][A-Za-z0-9_.-]*)\s*$\n\s{{4,}}\{{', 1), ',') AS functions,
 array_to_string(list_transform(names, lambda x: x || CASE WHEN regexp_extract(b[instr(b, '    ' || x):], '(?m)^\s*type\s+([^;]+);', 1) <> '' THEN ': ' || trim(regexp_extract(b[instr(b, '    ' || x):], '(?m)^\s*type\s+([^;]+);', 1)) ELSE '' END), ',') AS boundaries,
 '(1 ' || p_size || ' 0),(0 0 0)' AS points, CAST(length(b) AS BIGINT) AS chars FROM k JOIN part USING (p_partkey)""")
def q123(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    lists = {"functions": C.function_names(t), "boundaries": C.boundary_types(t), "points": C.probe_locations(t)}
    return table(spark, d, "part").select("p_partkey", F.expr(_BLOCKS).alias("text")).select("p_partkey", *[F.array_join(c, ",").alias(n) for n, c in lists.items()], F.length(C.block(t, "boundaryField")).cast("long").alias("chars"))


_CJK = "translate(CAST({} AS STRING), '0123456789', '零一二三四五六七八九')"


@query("q124_alias_relevance", """WITH p AS (SELECT p_partkey, translate(CAST(100000 + p_partkey * 7919 AS VARCHAR), '0123456789', '零一二三四五六七八九') AS q, translate(CAST(1000 + p_partkey * 31 % 9000 AS VARCHAR), '0123456789', '零一二三四五六七八九') AS a, p_partkey % 10 = 0 AS own FROM part),
x AS (SELECT p_partkey, CASE WHEN own THEN a || q ELSE q END AS q, a FROM p),
b AS (SELECT *, list_distinct(list_transform(range(1, length(q)), lambda i: q[i:i + 1])) AS bq, list_distinct(list_transform(range(1, length(a)), lambda i: a[i:i + 1])) AS ba FROM x), s AS (SELECT *, len(list_intersect(ba, bq)) AS n FROM b)
SELECT p_partkey, round(CAST(CASE WHEN n = 0 THEN 0 WHEN length(a) >= 3 AND contains(q, a) THEN 1 WHEN n >= 2 AND n / len(ba) >= 0.5 THEN 0.7 * n / len(ba) ELSE 0 END AS DOUBLE), 6) AS score FROM s""")
def q124(spark: SparkSession, d: str) -> DataFrame:
    asked, alias = F.expr(_CJK.format("100000 + p_partkey * 7919")), F.expr(_CJK.format("1000 + p_partkey * 31 % 9000"))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.concat(alias, asked)).otherwise(asked).alias("q"), F.array(alias, F.lit("no")).alias("aliases"))
    return rows.select("p_partkey", F.round(C.alias_relevance(F.col("q"), F.col("aliases")), 6).alias("score"))


_WROTE = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": 1, "k": 2}' WHEN 2 THEN '{"a": [NaN]}' WHEN 3 THEN '{"k": 1' WHEN 4 THEN concat(' ', props, ' and more') ELSE concat('{"type": "json_object", "content": ', props, '}') END"""


@query("q125_json_faults", """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'not_json' WHEN 4 THEN 'not_json' END AS fault, CASE event_id % 6 WHEN 1 THEN '{"k":2}' WHEN 2 THEN '{"a":[NaN]}' WHEN 3 THEN NULL ELSE replace(props, ' ', '') END AS object FROM events""")
def q125(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.expr(_WROTE).alias("text"))
    return rows.select("event_id", J.json_fault(F.col("text")).alias("fault"), J.json_prefix(F.col("text")).alias("object"))


@query("q126_impulse_issues", """WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 'p' WHEN 1 THEN 'U' ELSE 'T' END)) AS f FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey)
SELECT c_custkey, concat(CASE WHEN c_custkey % 3 = 1 THEN 'calculateImpulse reported an invalid or missing pressure field;' END, CASE WHEN c_custkey % 3 <> 2 AND NOT coalesce(list_contains(f, 'p'), false) THEN 'calculateImpulse requires pressureProbes/p, but available probe fields are: ' || coalesce(array_to_string(f, ', '), 'none') || ';' END) AS issues FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def q126(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("c_custkey"), F.col("o_orderkey") % 5
    fields = table(spark, d, "orders").where("o_custkey % 7 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.when(o == 0, "p").when(o == 1, "U").otherwise("T")).alias("fields"))
    said = F.when(k % 3 == 0, "calculateImpulse done").when(k % 3 == 1, "calculateImpulse: Could not determine a pressure field").otherwise("valid probe fields are many")
    issues = C.impulse_issues(said, F.col("fields"))
    return table(spark, d, "customer").join(fields, "c_custkey", "left").select("c_custkey", F.array_join(F.transform(issues, lambda x: F.concat(x, F.lit(";"))), "").alias("issues"))
