"""Checks of recorded runs: benchmark checks, contracts of reports, preflight scans, and what a delivery amounts to.

Inputs are tables of files ``(by, path, text)`` and of runs; nothing is executed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_end, report_reasons
from tessera.operators.selection import checked

#: Marks of logs and scripts.  Fixed values.
FAILURE = r"(?im)(traceback|uncaught|workflow failed)"
PARALLEL = r"(^|\s)(runParallel|mpirun|mpiexec)(\s|$)"
DYNAMIC_CODE = r"#\s*(calc|codeStream)\b|\bdynamicCode\b"
COMMAND = r"\b(?:runApplication|runParallel)\s+(?:-[A-Za-z]\s+\S+\s+)*([A-Za-z][A-Za-z0-9_.+-]*)"
INVALID = r"(?i)FOAM FATAL|segmentation fault|\b(?:nan|[+-]?inf)\b"
LAST_TIME, ENDED = r"(?m)^Time = ([0-9.eE+-]+)\s*$", r"(?m)^End\s*$"
LOWEST = r"min\(T\):\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
#: Checks that a benchmark run must pass, and those that count where it was executed.
REQUIRED = [
    "required_reports_present", "physics_report_present", "workflow_log_has_completion_marker", "workflow_failure_absent",
    "selected_tutorial_matches_expected", "case_selection_error_absent", "orchestrator_empty_output_absent",
    "openfoam_blocking_diagnostics_absent", "artifact_contract_ok",
]
EXECUTED = ["execution_report_present", "execution_status_present", "execution_status_completed", "solver_log_has_end"]


def _named(files: DataFrame, by: str, names: list[str]) -> DataFrame:
    """One row for each ``by``: the text of each of a few named files, null where there is none."""
    wanted = files.where(F.col("path").isin(*names))
    return wanted.groupBy(by).agg(*[F.max(F.when(F.col("path") == n, F.coalesce("text", F.lit("")))).alias(n) for n in names])


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def benchmark_checks(runs: DataFrame, files: DataFrame, by: str, marker: str) -> DataFrame:
    """``runs`` with ``checks``, ``issues`` and ``passed``.

    ``runs`` is ``(by, case_id, log, selected, keywords, reports, blocking, executed, dry_run,
    timed_out, exit_code)``: the workflow's log, the tutorial that was chosen, words of
    which it must have one (if any), names of required reports, and the number of
    blocking diagnostics.  A run that was not run, timed out or did not end with 0
    has not passed, whatever its checks say.
    """
    held = runs.join(_named(files, by, ["physics_report.md", "execution_report.md", "execution_status.json", "artifact_contract.json", "log.solver"]), by, "left")
    present = files.groupBy(by).agg(F.collect_set(F.when(~F.col("path").contains("/"), F.col("path"))).alias("_top"))
    held = held.join(present, by, "left")
    log = F.coalesce(F.col("log"), F.lit(""))
    status = _col("execution_status.json")
    value = lambda key: F.get_json_object(status, f"$.{key}")
    chosen = F.lower(F.coalesce("selected", F.lit("")))
    wanted = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)
    checks = {
        "required_reports_present": F.size(F.array_except("reports", F.coalesce("_top", F.array().cast("array<string>")))) == 0,
        "physics_report_present": _col("physics_report.md").isNotNull(),
        "execution_report_present": _col("execution_report.md").isNotNull(),
        "execution_status_present": status.isNotNull(),
        "execution_status_completed": (value("success") == "true") | (value("completed") == "true") | F.lower(F.coalesce(value("status"), F.lit(""))).isin("completed", "success", "succeeded"),
        "solver_log_has_end": clean_end(_col("log.solver")),
        "workflow_log_has_completion_marker": F.contains(log, F.concat(F.lit(f"{marker} case_id="), F.col("case_id").cast("string"))),
        "workflow_failure_absent": ~log.rlike(FAILURE),
        "selected_tutorial_matches_expected": (chosen != "") & ((F.size(wanted) == 0) | F.exists(wanted, lambda w: F.contains(chosen, w))),
        "case_selection_error_absent": ~F.contains(F.lower(log), F.lit("case selection error")),
        "orchestrator_empty_output_absent": log.rlike(r"\S"),
        "openfoam_blocking_diagnostics_absent": F.coalesce("blocking", F.lit(0)) == 0,
        "artifact_contract_ok": F.get_json_object(_col("artifact_contract.json"), "$.ok") == "true",
    }
    found = checked(held, checks, REQUIRED)
    also = ~F.coalesce("executed", F.lit(False)) | ~F.arrays_overlap("issues", F.array(*map(F.lit, EXECUTED)))
    ran = ~F.coalesce("dry_run", F.lit(False)) & ~F.coalesce("timed_out", F.lit(False)) & F.coalesce(F.col("exit_code") == 0, F.lit(False))
    return found.withColumn("passed", ran & F.col("passed") & also).select(*runs.columns, "checks", "issues", "passed")


def artifact_contract(runs: DataFrame, files: DataFrame, by: str, least: dict[str, int]) -> DataFrame:
    """``(by, ok, issues)``: what is wrong with a run's reports and end, in order.

    ``runs`` is ``(by, require_execution, require_review, validation, categories)``:
    what must be there, the reviewer's word, and the names of blocking diagnostics;
    ``least`` the fewest characters of each report.
    """
    names = ["physics_report.md", "execution_report.md", "post_processing_report.md", "review_report.md"]
    held = runs.join(_named(files, by, [*names, "execution_status.json"]), by, "left")

    def report(name: str) -> Column:
        text = _col(name)
        reasons = report_reasons(text, name.removesuffix(".md"), least.get(name, 80))
        why = F.when(text.isNull(), F.lit(f"{name} is missing")).when(F.size(reasons) > 0, F.array_join(reasons, "; "))
        return F.when(why.isNotNull(), F.concat(F.lit(f"{name} invalid: "), why))

    status = _col("execution_status.json")
    done = (F.get_json_object(status, "$.run_status") == "completed") & (F.get_json_object(status, "$.final_status") == "success")
    unread = status.isNull() | F.get_json_object(status, "$").isNull()
    state = F.when(unread, "execution_status.json is missing or unreadable").when(~F.coalesce(done, F.lit(False)), "execution_status.json does not mark execution successful")
    blocked = F.when(F.size("categories") > 0, F.concat(F.lit("OpenFOAM blocking diagnostics present: "), F.array_join(F.array_sort(F.array_distinct("categories")), ", ")))
    review = F.when(~F.col("validation").eqNullSafe("passed"), F.concat(F.lit("validation_status is not passed: "), F.coalesce("validation", F.lit("None"))))
    executed = [F.when(F.col("require_execution"), c) for c in (report(names[1]), report(names[2]), state, blocked)]
    reviewed = [F.when(F.col("require_review"), c) for c in (report(names[3]), review)]
    issues = F.filter(F.array(report(names[0]), *executed, *reviewed), lambda x: x.isNotNull())
    return held.select(by, issues.alias("issues")).select(by, (F.size("issues") == 0).alias("ok"), "issues")


def preflight(cases: DataFrame, files: DataFrame, available: DataFrame, by: str, as_root: bool = False, launcher: bool = True) -> DataFrame:
    """``(by, ok, blockers, warnings, parallel, dynamic)`` of each case before it is run.

    ``available (command)`` names the commands that the place of execution has;
    those of the script that it lacks are a warning.  Parallel runs need a
    ``launcher``; dynamic code is not run ``as_root``.
    """
    script = _named(files, by, ["Allrun"])
    code = files.where(F.col("path").rlike(r"^(system|constant|0|0\.orig)/")).groupBy(by).agg(F.bool_or(F.coalesce("text", F.lit("")).rlike(DYNAMIC_CODE)).alias("dynamic"))
    asked = script.select(by, F.explode(F.array_distinct(F.regexp_extract_all("Allrun", F.lit(COMMAND), F.lit(1)))).alias("command")).where("command <> 'getApplication'")
    lacking = asked.join(available.select("command").distinct(), "command", "left_anti").groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("command")), ", ").alias("_l"))
    held = cases.select(by).distinct().join(script, by, "left").join(code, by, "left").join(lacking, by, "left")
    parallel, dynamic = F.coalesce(F.col("Allrun").rlike(PARALLEL), F.lit(False)), F.coalesce("dynamic", F.lit(False))
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    blockers = some(
        F.when(parallel & F.lit(not launcher), "Allrun uses parallel execution, but neither mpirun nor mpiexec is available"),
        F.when(dynamic & F.lit(as_root), "case uses OpenFOAM dynamic code (#calc/#codeStream), but execution is running as root"),
    )
    warnings = some(
        F.when(F.col("Allrun").isNull(), "Allrun is missing; execution agent may need to create it"),
        F.when(F.col("_l").isNotNull(), F.concat(F.lit("OpenFOAM commands not found in PATH before execution: "), "_l")),
    )
    told = held.select(by, blockers.alias("blockers"), warnings.alias("warnings"), parallel.alias("parallel"), dynamic.alias("dynamic"))
    return told.select(by, (F.size("blockers") == 0).alias("ok"), "blockers", "warnings", "parallel", "dynamic")


def delivery(runs: DataFrame, files: DataFrame, logs: DataFrame, by: str, until: float, required: list[str], fields: list[str], series: int) -> DataFrame:
    """``(by, conditions, completion, model_health, delivery, missing, status)`` of what was delivered.

    ``runs (by, errors, resources_known, guard, series)``: errors of conditions, whether
    resources were observed, the guard's word (null without one), and how many whole
    series there are; ``files (by, path)``; ``logs (by, text)`` of solvers.  A run is
    complete if a log without anomalies ends at ``until`` or later, all ``series`` are
    there, and the folder of its last time has all ``fields``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    number = lambda x: x.try_cast("double")
    times = F.transform(F.regexp_extract_all(text, F.lit(LAST_TIME), F.lit(1)), number)
    told = logs.select(by, F.element_at(F.slice(times, F.greatest(F.size(times), F.lit(1)), 1), 1).alias("last"), text.rlike(ENDED).alias("end"), text.rlike(INVALID).alias("invalid"), F.coalesce(F.exists(F.regexp_extract_all(text, F.lit(LOWEST), F.lit(1)), lambda x: number(x) <= 0), F.lit(False)).alias("cold"))
    solver = told.where("last is not null").groupBy(by).agg(
        F.bool_or(F.col("end") & (F.col("last") >= until) & ~F.col("invalid")).alias("ended"), F.bool_or(F.col("invalid") | F.col("cold")).alias("anomaly"), F.count("*").alias("n_logs")
    )
    folder = number(F.regexp_extract("path", r"^([^/]+)/", 1))
    timed = files.where(folder.isNotNull() & ~F.isnan(folder) & (folder >= until)).select(by, folder.alias("t"), F.regexp_extract("path", r"^[^/]+/(.*)$", 1).alias("name"))
    last = timed.groupBy(by).agg(F.max(F.struct("t")).alias("m")).select(by, F.col("m.t").alias("t"))
    whole = timed.join(last, [by, "t"]).where(F.col("name").isin(*fields)).groupBy(by).agg((F.count_distinct("name") == len(fields)).alias("fields"))
    one_of = ["report.md", "report.pdf"]
    there = files.where(F.col("path").isin(*required, *one_of) | F.startswith("path", F.lit("logs/"))).groupBy(by).agg(F.collect_set("path").alias("there"), F.bool_or(F.startswith("path", F.lit("logs/"))).alias("has_logs"))
    held = runs.join(solver, by, "left").join(whole, by, "left").join(there, by, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    got = F.coalesce("there", F.array().cast("array<string>"))
    missing = F.concat(
        F.array_except(F.array(*map(F.lit, required)), got),
        F.when(F.arrays_overlap(got, F.array(*map(F.lit, one_of))), F.array().cast("array<string>")).otherwise(F.array(F.lit("report.md_or_pdf"))),
        F.when(yes("has_logs"), F.array().cast("array<string>")).otherwise(F.array(F.lit("logs/"))),
    )
    conditions = F.when(F.size("errors") > 0, "fail").when(yes("resources_known"), "pass").otherwise("unknown_resources")
    complete = yes("ended") & (F.col("series") == series) & yes("fields") & (F.col("guard").isNull() | (F.col("guard") == "process_completed"))
    sick = yes("anomaly") | F.col("guard").eqNullSafe("model_anomaly_stop")
    health = F.when(sick, "observed_anomaly").when(F.col("n_logs").isNull(), "unknown_no_solver_evidence").otherwise("no_anomaly_in_available_evidence")
    said = held.select(by, conditions.alias("conditions"), F.when(complete, "pass_file_evidence").otherwise("fail_or_incomplete").alias("completion"), health.alias("model_health"), missing.alias("missing"))
    delivered = said.withColumn("delivery", F.when(F.size("missing") == 0, "files_present_content_review_required").otherwise("incomplete"))
    fine = (F.col("completion") == "pass_file_evidence") & (F.col("conditions") == "pass") & (F.size("missing") == 0)
    status = F.when(F.col("model_health") == "observed_anomaly", "model_anomaly_stop").when(fine, "development_evidence_collected").otherwise("development_incomplete")
    return delivered.select(by, "conditions", "completion", "model_health", "delivery", "missing", status.alias("status"))
