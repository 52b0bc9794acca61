"""Queries of recorded runs.  Runs and their files are made of customers by expressions that Spark and SQL both evaluate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import REPORT_EMPTY, REPORT_ERRORS, REPORT_SHORT
from tessera.operators import budgets, ranking, runs
from tessera.plans.common import PASSAGES_SQL, hits_sql, table, texts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_LONG = "repeat('The run went as planned and its pressures agree with the tables. ', 1 + c_custkey % 3)"
#: (path, text, condition) of the files of each run.
FILES = [
    ("physics_report.md", f"CASE c_custkey % 8 WHEN 0 THEN 'short' WHEN 1 THEN '' ELSE {_LONG} END", "c_custkey % 9 <> 0"),
    ("execution_report.md", _LONG, "c_custkey % 4 <> 0"),
    ("post_processing_report.md", "CASE WHEN c_custkey % 5 = 0 THEN concat('error: ', c_custkey) ELSE " + _LONG + " END", "c_custkey % 6 <> 0"),
    ("review_report.md", _LONG, "c_custkey % 7 <> 0"),
    ("execution_status.json", """CASE c_custkey % 5 WHEN 0 THEN '{"status":"Completed","run_status":"completed","final_status":"success"}' WHEN 1 THEN '{"success":true,"run_status":"failed"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"status":"failed","completed":false}' ELSE '{"completed":true,"run_status":"completed","final_status":"success"}' END""", "c_custkey % 11 <> 0"),
    ("artifact_contract.json", "CASE WHEN c_custkey % 13 = 0 THEN '{\"ok\":false}' ELSE '{\"ok\":true}' END", "c_custkey % 17 <> 0"),
    ("log.solver", "concat('Time = 1e-4', chr(10), 'min(T): ', c_custkey % 10, chr(10), 'Time = ', c_custkey % 3, 'e-4', chr(10), CASE WHEN c_custkey % 12 = 0 THEN 'FOAM FATAL ERROR' ELSE 'ok' END, CASE WHEN c_custkey % 4 > 0 THEN concat(chr(10), 'End', chr(10)) ELSE '' END)", "c_custkey % 15 <> 0"),
    ("Allrun", "CASE c_custkey % 4 WHEN 0 THEN concat('runParallel ', 'solver', chr(10), 'runApplication -s a setFields') WHEN 1 THEN 'runApplication blockMesh; runApplication $(getApplication)' WHEN 2 THEN concat('echo runs', chr(10), 'runApplication tool', c_custkey % 3) ELSE 'mpirunner x' END", "c_custkey % 10 <> 0"),
    ("system/controlDict", "CASE WHEN c_custkey % 6 = 0 THEN 'x #calc \"1\";' WHEN c_custkey % 6 = 1 THEN 'dynamicCodeless' ELSE 'a b;' END", "c_custkey % 3 > 0 OR c_custkey % 6 = 0"),
    ("notes/controlDict", "'#codeStream'", "c_custkey % 2 = 0"),
    ("0.0002/p", "'p'", "c_custkey % 4 <> 3"),
    ("0.0002/rho", "'rho'", "c_custkey % 5 <> 4"),
    ("0.0001/rho", "'rho'", "c_custkey % 2 = 0"),
    ("3e-4/p", "'p'", "c_custkey % 19 = 0"),
    ("run.sh", "''", "c_custkey % 14 <> 0"),
    ("report.pdf", "''", "c_custkey % 16 <> 0"),
    ("logs/a", "''", "c_custkey % 18 <> 0"),
]
_LOG = "CASE c_custkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN concat('DONE case_id=', c_custkey, ' ok') WHEN 2 THEN concat('DONE case_id=', c_custkey, chr(10), 'Traceback (most') WHEN 3 THEN concat('Case Selection Error DONE case_id=', c_custkey) WHEN 4 THEN concat('x DONE case_id=', c_custkey) ELSE 'still at work' END"
_SELECTED = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('tutorials/', c_mktsegment, '/a') END"


def _files_sql() -> str:
    return "files AS (" + " UNION ALL ".join(f"SELECT c_custkey, '{path}' AS path, {text} AS text FROM customer WHERE {cond}" for path, text, cond in FILES) + ")"


def run_files(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    each = [customers.where(cond).select("c_custkey", F.lit(path).alias("path"), F.expr(text).alias("text")) for path, text, cond in FILES]
    return reduce(DataFrame.unionByName, each)


def _file(name: str) -> str:
    return f"(SELECT max(text) FROM files f WHERE f.c_custkey = r.c_custkey AND f.path = '{name}')"


_JSON = "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$.{1}') END"


@query("q141_benchmark_checks", f"""WITH {_files_sql()},
r AS (SELECT c_custkey, {_LOG} AS log, {_SELECTED} AS selected, c_custkey % 3 = 0 AS executed, c_custkey % 20 = 1 AS dry, c_custkey % 22 = 0 AS late, CASE WHEN c_custkey % 21 = 0 THEN 1 ELSE 0 END AS code, c_custkey % 23 = 0 AS blocking FROM customer),
t AS (SELECT r.*, {_file('physics_report.md')} AS physics, {_file('execution_report.md')} AS report, {_file('execution_status.json')} AS status, {_file('artifact_contract.json')} AS contract, {_file('log.solver')} AS solver, {_file('review_report.md')} AS review FROM r),
c AS (SELECT c_custkey, executed, dry, late, code, list_filter([
  CASE WHEN physics IS NULL OR review IS NULL THEN 'required_reports_present' END, CASE WHEN physics IS NULL THEN 'physics_report_present' END, CASE WHEN report IS NULL THEN 'execution_report_present' END, CASE WHEN status IS NULL THEN 'execution_status_present' END,
  CASE WHEN NOT coalesce({_JSON.format('status', 'success')} = 'true' OR {_JSON.format('status', 'completed')} = 'true' OR lower({_JSON.format('status', 'status')}) IN ('completed', 'success', 'succeeded'), false) THEN 'execution_status_completed' END,
  CASE WHEN NOT coalesce(contains(solver, chr(10) || 'End' || chr(10)) OR ends_with(rtrim(solver), 'End'), false) THEN 'solver_log_has_end' END,
  CASE WHEN NOT contains(log, 'DONE case_id=' || c_custkey) THEN 'workflow_log_has_completion_marker' END, CASE WHEN contains(lower(log), 'traceback') THEN 'workflow_failure_absent' END,
  CASE WHEN NOT coalesce(contains(lower(selected), 'auto') OR contains(lower(selected), 'b'), false) THEN 'selected_tutorial_matches_expected' END, CASE WHEN contains(lower(log), 'case selection error') THEN 'case_selection_error_absent' END,
  CASE WHEN trim(log) = '' THEN 'orchestrator_empty_output_absent' END, CASE WHEN blocking THEN 'openfoam_blocking_diagnostics_absent' END, CASE WHEN NOT coalesce({_JSON.format('contract', 'ok')} = 'true', false) THEN 'artifact_contract_ok' END], lambda x: x IS NOT NULL) AS issues FROM t)
SELECT c_custkey, array_to_string(issues, ',') AS issues, NOT dry AND NOT late AND code = 0 AND len(list_filter(issues, lambda x: x NOT IN ('execution_report_present', 'execution_status_present', 'execution_status_completed', 'solver_log_has_end') OR executed)) = 0 AS passed FROM c""")
def q141(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    made = table(spark, d, "customer").select(
        "c_custkey", k.alias("case_id"), F.expr(_LOG).alias("log"), F.expr(_SELECTED).alias("selected"), F.array(F.lit("AUTO"), F.lit("b")).alias("keywords"), F.array(F.lit("physics_report.md"), F.lit("review_report.md")).alias("reports"),
        F.when(k % 23 == 0, 2).otherwise(0).alias("blocking"), (k % 3 == 0).alias("executed"), (k % 20 == 1).alias("dry_run"), (k % 22 == 0).alias("timed_out"), F.when(k % 21 == 0, 1).otherwise(0).alias("exit_code"),
    )
    found = runs.benchmark_checks(made, run_files(spark, d), "c_custkey", "DONE")
    return found.select("c_custkey", F.array_join("issues", ",").alias("issues"), "passed")


def _report_sql(name: str, text: str, least: int) -> str:
    """The reasons against a report, by the same table of patterns."""
    bare = rf"regexp_replace({text}, '\A\s+|\s+\z', '', 'g')"
    quoted = lambda x: x.replace("'", "''")
    each = [f"CASE WHEN {bare} = '' THEN '{quoted(REPORT_EMPTY)}' END"]
    each += [f"CASE WHEN regexp_matches({bare if stripped else text}, '{quoted(pattern)}') THEN '{quoted(why)}' END" for pattern, stripped, why in REPORT_ERRORS]
    each.append(f"CASE WHEN length({bare}) < {least} THEN '{name.removesuffix('.md')} {quoted(REPORT_SHORT)}' END")
    found = f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN {text} IS NULL THEN '{name} invalid: {name} is missing' WHEN len({found}) > 0 THEN '{name} invalid: ' || array_to_string({found}, '; ') END"


@query("q142_contracts", f"""WITH {_files_sql()},
r AS (SELECT c_custkey, c_custkey % 2 = 0 AS e, c_custkey % 3 = 0 AS v, CASE c_custkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END AS validation, c_custkey % 5 = 1 AS b FROM customer),
t AS (SELECT r.*, {_file('physics_report.md')} AS p, {_file('execution_report.md')} AS x, {_file('post_processing_report.md')} AS o, {_file('review_report.md')} AS w, {_file('execution_status.json')} AS s FROM r),
i AS (SELECT c_custkey, list_filter([{_report_sql('physics_report.md', 'p', 100)}, CASE WHEN e THEN {_report_sql('execution_report.md', 'x', 80)} END, CASE WHEN e THEN {_report_sql('post_processing_report.md', 'o', 80)} END,
  CASE WHEN e THEN CASE WHEN s IS NULL OR NOT json_valid(s) THEN 'execution_status.json is missing or unreadable' WHEN NOT coalesce(json_extract_string(s, '$.run_status') = 'completed' AND json_extract_string(s, '$.final_status') = 'success', false) THEN 'execution_status.json does not mark execution successful' END END,
  CASE WHEN e AND b THEN 'OpenFOAM blocking diagnostics present: a, mesh' END, CASE WHEN v THEN {_report_sql('review_report.md', 'w', 80)} END, CASE WHEN v AND validation IS DISTINCT FROM 'passed' THEN 'validation_status is not passed: ' || coalesce(validation, 'None') END], lambda x: x IS NOT NULL) AS issues FROM t)
SELECT c_custkey, len(issues) = 0 AS ok, array_to_string(issues, chr(10)) AS issues FROM i""")
def q142(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    categories = F.when(k % 5 == 1, F.array(F.lit("mesh"), F.lit("a"), F.lit("mesh"))).otherwise(F.array().cast("array<string>"))
    made = table(spark, d, "customer").select("c_custkey", (k % 2 == 0).alias("require_execution"), (k % 3 == 0).alias("require_review"), F.when(k % 4 == 0, "passed").when(k % 4 == 1, "failed").alias("validation"), categories.alias("categories"))
    found = runs.artifact_contract(made, run_files(spark, d), "c_custkey", {"physics_report.md": 100})
    return found.select("c_custkey", "ok", F.array_join("issues", "\n").alias("issues"))


@query("q143_preflight", rf"""WITH {_files_sql()},
r AS (SELECT c_custkey, (SELECT max(text) FROM files f WHERE f.c_custkey = c.c_custkey AND path = 'Allrun') AS s, coalesce((SELECT max(regexp_matches(text, '#\s*(calc|codeStream)\b|\bdynamicCode\b')) FROM files f WHERE f.c_custkey = c.c_custkey AND regexp_matches(path, '^(system|constant|0|0\.orig)/')), false) AS dynamic FROM customer c),
t AS (SELECT c_custkey, s, dynamic, coalesce(regexp_matches(s, '(^|\s)(runParallel|mpirun|mpiexec)(\s|$)'), false) AS parallel,
  list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(s, ''), '\b(?:runApplication|runParallel)\s+(?:-[A-Za-z]\s+\S+\s+)*([A-Za-z][A-Za-z0-9_.+-]*)', 1), lambda x: x NOT IN ('getApplication', 'blockMesh', 'tool1')))) AS lacking FROM r),
u AS (SELECT *, list_filter([CASE WHEN parallel THEN 'Allrun uses parallel execution, but neither mpirun nor mpiexec is available' END, CASE WHEN dynamic THEN 'case uses OpenFOAM dynamic code (#calc/#codeStream), but execution is running as root' END], lambda x: x IS NOT NULL) AS blockers,
  list_filter([CASE WHEN s IS NULL THEN 'Allrun is missing; execution agent may need to create it' END, CASE WHEN len(lacking) > 0 THEN 'OpenFOAM commands not found in PATH before execution: ' || array_to_string(lacking, ', ') END], lambda x: x IS NOT NULL) AS warnings FROM t)
SELECT c_custkey, len(blockers) = 0 AS ok, array_to_string(blockers, chr(10)) AS blockers, array_to_string(warnings, chr(10)) AS warnings, parallel, dynamic FROM u""")
def q143(spark: SparkSession, d: str) -> DataFrame:
    available = spark.createDataFrame([("blockMesh",), ("tool1",)], "command string")
    found = runs.preflight(table(spark, d, "customer").select("c_custkey"), run_files(spark, d), available, "c_custkey", as_root=True, launcher=False)
    return found.select("c_custkey", "ok", F.array_join("blockers", "\n").alias("blockers"), F.array_join("warnings", "\n").alias("warnings"), "parallel", "dynamic")


@query("q144_delivery", rf"""WITH {_files_sql()},
r AS (SELECT c_custkey, c_custkey % 9 = 0 AS wrong, c_custkey % 4 <> 1 AS known, CASE c_custkey % 10 WHEN 0 THEN 'model_anomaly_stop' WHEN 1 THEN 'timeout' WHEN 2 THEN 'process_completed' END AS guard, CASE WHEN c_custkey % 8 = 0 THEN 2 ELSE 3 END AS series FROM customer),
l AS (SELECT c_custkey, text, list_transform(regexp_extract_all(text, '(?m)^Time = ([0-9.eE+-]+)\s*$', 1), lambda x: TRY_CAST(x AS DOUBLE)) AS ts FROM files WHERE path = 'log.solver'),
s AS (SELECT c_custkey, ts[-1] >= 0.0002 AND regexp_matches(text, '(?m)^End\s*$') AND NOT regexp_matches(text, '(?i)FOAM FATAL|segmentation fault') AS ended, regexp_matches(text, '(?i)FOAM FATAL|segmentation fault') OR len(list_filter(regexp_extract_all(text, 'min\(T\):\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)', 1), lambda x: CAST(x AS DOUBLE) <= 0)) > 0 AS anomaly FROM l WHERE ts[-1] IS NOT NULL),
f AS (SELECT c_custkey, TRY_CAST(split_part(path, '/', 1) AS DOUBLE) AS t, split_part(path, '/', 2) AS name FROM files WHERE contains(path, '/')),
g AS (SELECT c_custkey, count(DISTINCT name) FILTER (name IN ('p', 'rho')) = 2 AS fields FROM f JOIN (SELECT c_custkey, max(t) AS m FROM f WHERE t >= 0.0002 GROUP BY ALL) USING (c_custkey) WHERE t = m GROUP BY ALL),
h AS (SELECT r.*, coalesce(ended, false) AS ended, coalesce(anomaly, false) OR coalesce(guard = 'model_anomaly_stop', false) AS sick, anomaly IS NULL AS unseen, coalesce(fields, false) AS fields,
  list_filter([CASE WHEN NOT EXISTS (SELECT 1 FROM files x WHERE x.c_custkey = r.c_custkey AND path = 'run.sh') THEN 'run.sh' END, CASE WHEN NOT EXISTS (SELECT 1 FROM files x WHERE x.c_custkey = r.c_custkey AND path IN ('report.md', 'report.pdf')) THEN 'report.md_or_pdf' END, CASE WHEN NOT EXISTS (SELECT 1 FROM files x WHERE x.c_custkey = r.c_custkey AND starts_with(path, 'logs/')) THEN 'logs/' END], lambda x: x IS NOT NULL) AS missing
  FROM r LEFT JOIN s USING (c_custkey) LEFT JOIN g USING (c_custkey)),
o AS (SELECT *, CASE WHEN wrong THEN 'fail' WHEN known THEN 'pass' ELSE 'unknown_resources' END AS conditions, ended AND series = 3 AND fields AND coalesce(guard, 'process_completed') = 'process_completed' AS complete FROM h)
SELECT c_custkey, conditions, CASE WHEN complete THEN 'pass_file_evidence' ELSE 'fail_or_incomplete' END AS completion, CASE WHEN sick THEN 'observed_anomaly' WHEN unseen THEN 'unknown_no_solver_evidence' ELSE 'no_anomaly_in_available_evidence' END AS model_health,
 CASE WHEN len(missing) = 0 THEN 'files_present_content_review_required' ELSE 'incomplete' END AS delivery, array_to_string(missing, ',') AS missing, CASE WHEN sick THEN 'model_anomaly_stop' WHEN complete AND conditions = 'pass' AND len(missing) = 0 THEN 'development_evidence_collected' ELSE 'development_incomplete' END AS status FROM o""")
def q144(spark: SparkSession, d: str) -> DataFrame:
    k, files = F.col("c_custkey"), run_files(spark, d)
    errors = F.when(k % 9 == 0, F.array(F.lit("mesh"))).otherwise(F.array().cast("array<string>"))
    guard = F.when(k % 10 == 0, "model_anomaly_stop").when(k % 10 == 1, "timeout").when(k % 10 == 2, "process_completed")
    made = table(spark, d, "customer").select("c_custkey", errors.alias("errors"), (k % 4 != 1).alias("resources_known"), guard.alias("guard"), F.when(k % 8 == 0, 2).otherwise(3).alias("series"))
    found = runs.delivery(made, files.select("c_custkey", "path"), files.where("path = 'log.solver'").select("c_custkey", "text"), "c_custkey", 0.0002, ["run.sh"], ["p", "rho"], 3)
    return found.withColumn("missing", F.array_join("missing", ","))


@query("q145_planned_bm25", f"""WITH RECURSIVE {PASSAGES_SQL}, {hits_sql("concat('docs/', doc_id, chr(10), text)", "concat(coalesce(text, ''), chr(10), CASE WHEN item_id % 2 = 0 THEN concat('docs ', item_id) ELSE '' END, CASE WHEN item_id % 3 = 0 THEN concat(chr(10), 'need', item_id, chr(10), 'other') ELSE '' END)")}
SELECT item_id, passage_id, score, rank FROM hits WHERE rank <= 10""")
def q145(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their paths, for items with a translation and needs of a plan."""
    k = F.col("item_id")
    needs = F.when(k % 3 == 0, F.array(F.concat(F.lit("need"), k.cast("string")), F.lit("other")))
    asked = table(spark, d, "benchmark").select("item_id", ranking.plan_text(F.coalesce("text", F.lit("")), F.when(k % 2 == 0, F.concat(F.lit("docs "), k.cast("string"))), needs).alias("text"))
    units = ranking.passages(texts(spark, d)).withColumn("text", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("\n"), "text"))
    return ranking.bm25(units, asked, "passage_id", "item_id", 10).select("item_id", "passage_id", "score", F.col("rank").cast("long").alias("rank"))


_TURNS = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS turn, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem"


@query("q146_turn_accounts", f"""WITH t AS ({_TURNS}),
v AS (SELECT *, 100 * q AS counted, 100 * q + CASE WHEN l_suppkey % 29 = 0 THEN 1 ELSE 0 END AS prompt, CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE q * 3 END AS completion FROM t),
r AS (SELECT *, CASE WHEN counted + 148 > 4900 THEN 'input_budget_exhausted' WHEN l_partkey % 37 = 0 THEN 'timeout' WHEN l_partkey % 41 = 0 THEN 'model_identity_mismatch' WHEN completion IS NULL THEN 'usage_unknown' WHEN prompt <> counted THEN 'tokenizer_mismatch' WHEN completion > 148 THEN 'output_budget_violation' WHEN l_suppkey % 23 = 0 THEN 'completion_truncated' WHEN l_suppkey % 19 = 0 THEN 'invalid_action' WHEN l_partkey % 7 = 0 THEN 'answered' END AS why FROM v),
e AS (SELECT l_orderkey, min(turn) AS last, arg_min(why, turn) AS why FROM r WHERE why IS NOT NULL GROUP BY ALL),
k AS (SELECT r.l_orderkey, r.turn, r.counted, r.completion, r.why, e.why AS ended FROM r LEFT JOIN e USING (l_orderkey) WHERE last IS NULL OR turn <= last)
SELECT l_orderkey, coalesce(max(ended), CASE WHEN count(*) >= 5 THEN 'turn_budget_exhausted' ELSE 'open' END) AS status, count(*) FILTER (why IS DISTINCT FROM 'input_budget_exhausted') AS n_turns, CAST(coalesce(sum(counted) FILTER (why IS DISTINCT FROM 'input_budget_exhausted'), 0) AS BIGINT) AS counted_input,
 CAST(coalesce(sum(completion) FILTER (coalesce(why, '') NOT IN ('input_budget_exhausted', 'timeout', 'model_identity_mismatch', 'usage_unknown', 'tokenizer_mismatch')), 0) AS BIGINT) AS completion FROM k GROUP BY l_orderkey""")
def q146(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as recorded turns."""
    from tessera.plans.evidence import _placed

    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    turns = _placed(spark, d).select(
        "l_orderkey", (F.col("place") - 1).alias("turn"), (100 * q).alias("counted"), F.lit(148).alias("max_tokens"), F.when(p % 37 == 0, "timeout").otherwise("response").alias("status"), (p % 41 != 0).alias("same_model"),
        (100 * q + F.when(s % 29 == 0, 1).otherwise(0)).alias("prompt"), F.when(p % 31 != 0, q * 3).alias("completion"), F.when(s % 23 == 0, "length").otherwise("stop").alias("finish"), F.when(s % 19 == 0, None).when(p % 7 == 0, "final").otherwise("search").alias("action"),
    )
    return budgets.turn_accounts(turns, "l_orderkey", 4_900, 5)


@query("q147_shrunk_excerpts")
def q147(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation as excerpts of a packet of 600 characters; a brute-force test stands in for SQL."""
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), "text")
    fixed = turns.groupBy("conv_id").agg((40 + 30 * F.count("*")).alias("chars"))
    return budgets.shrunk_excerpts(turns, fixed, "conv_id", 600)


@query("q148_rewrites", """SELECT event_type, user_id, count(*) AS n, CASE WHEN min(CASE WHEN coalesce(value, 0) > 20 THEN 1 ELSE 0 END) = 1 THEN 'all_success' WHEN max(CASE WHEN coalesce(value, 0) > 20 THEN 1 ELSE 0 END) = 0 THEN 'all_failure' ELSE 'mixed_success' END AS outcome FROM events GROUP BY ALL""")
def q148(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events as arms and users as items."""
    return budgets.rewrite_consistency(table(spark, d, "events").withColumn("ok", F.col("value") > 20), "event_type", "user_id", "ok")
