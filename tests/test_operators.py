"""Hand-made cases of functions and operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, graphs, logs, ranges, ranking
from tessera.operators.structure import dictionary_entries, include_edges, markdown_headings, parse_dictionary


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_tokens_camel_pieces_and_cjk(spark):
    got = one(spark, T.tokens(F.col("x")), "JWL x", "runTimeModel the", "a1B22", "压力场", None, "")
    assert got[0] == ["jwl", "x", "jw", "x"]
    assert got[1] == ["runtimemodel", "run", "time", "model"]
    assert got[2] == ["a1b22", "1", "22"]  # the piece "a" is a stop word, the capital before a digit belongs to nothing
    assert got[3] == ["压力", "力场"]
    assert got[4] == got[5] == []


def test_redaction(spark):
    text = "api_key = abc\nauthorization: Bearer abcdefghijklmnop\n{\"password\": \"x y\", 'token': 'q', secret: zz}\nsk-abcdefghijklmnop plain"
    got = one(spark, T.redact(F.col("x")), text, None)
    assert got[0] == "api_key = <REDACTED>\nauthorization: Bearer <REDACTED>\n{\"password\": \"<REDACTED>\", 'token': '<REDACTED>', secret: <REDACTED>}\n<REDACTED> plain"
    assert got[1] == ""


def test_sensitive_paths_and_globs(spark):
    assert one(spark, T.sensitive_path(F.col("x")), "a/x/.env", ".env.local", "b/credentials.json", "env", None) == [True, True, True, False, False]
    import re

    assert re.search(T.glob_regex("a/**/b.txt"), "a/b.txt") and re.search(T.glob_regex("a/**/b.txt"), "a/x/y/b.txt")
    assert not re.search(T.glob_regex("a/*/b"), "a/x/y/b") and re.search(T.glob_regex("*.txt"), "q/w.txt")


def test_anomalies_and_numbers(spark):
    assert one(spark, T.anomaly(F.col("x")), "x nan", "min(T): -3", "min(T): 3", None) == ["nonfinite_or_fatal", "nonpositive_temperature", None, None]
    assert one(spark, T.number_after(F.col("x"), "end"), "end time: 1e-5 s", "none") == [1e-5, None]


def test_passages_pack_whole_lines(spark):
    docs = spark.createDataFrame([(1, "a" * 10 + "\n" + "b" * 10 + "\n" + "c" * 30 + "\nd"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in ranking.passages(docs, size=25, overlap=1).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 4)]


def test_merge_and_overlap(spark):
    r = spark.createDataFrame([("p", 1, 3), ("p", 4, 5), ("p", 8, 9), ("p", 1, 3)], "path string, start long, end long")
    assert sorted((x.start, x.end, x.n) for x in ranges.merge_ranges(r, ["path"]).collect()) == [(1, 5, 3), (8, 9, 1)]
    a = spark.createDataFrame([("p", 1, 200), ("p", 300, 301)], "path string, a_start long, a_end long")
    b = spark.createDataFrame([("p", 150, 400), ("p", 201, 299)], "path string, b_start long, b_end long")
    assert ranges.overlap_join(a, b, ["path"]).count() == 2


def test_components_and_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    assert {r.node: r.component for r in graphs.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    roots = spark.createDataFrame([("a",), ("z",)], "root string")
    assert sorted((r.root, r.node) for r in graphs.closure(roots, cycle).collect()) == [("a", "a"), ("a", "b"), ("z", "z")]


def test_agreement_and_composite(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (None, 1.0)], "left double, right double")
    r = evaluation.agreement(pairs).first()
    assert (r.n, r.unknown_pairs, r.exact, r.mae) == (2, 1, 0.5, 0.5)
    rows = spark.createDataFrame([([0.25, 0.75], 0.75, 1.0, True, False), ([None, 1.0], 1.0, None, False, False), ([1.0], 1.0, 1.0, True, True)], "points array<double>, f double, a double, conditional boolean, failed boolean")
    got = evaluation.composite(rows).collect()
    assert got[0].arith == 75.0 and got[1].arith is None and (got[1].arith_low, got[1].arith_high) == (75.0, 100.0) and got[2].arith == 0.0


def test_grades(spark):
    rows = [("single", "x\nFINAL: A", "answered", "A"), ("single", "FINAL: A\ntail", "answered", "A"), ("numeric", "FINAL: 1e3", "answered", "1000"), ("fill", "FINAL: q", None, "q")]
    got = [(r.score, r.reason) for r in evaluation.grade(spark.createDataFrame(rows, "kind string, answer string, status string, gold string")).collect()]
    assert got == [(1, "correct"), (0, "missing_or_multiple_final_marker"), (1, "correct"), (None, "not_run_or_outcome_unknown")]


def test_diagnosis_by_rules(spark):
    from tessera.plans import log_rules

    rows = ["before", "--> FOAM FATAL IO ERROR warning", "", "\tkeyword gamma is undefined ", "x", "x", "x", "x", "a warning of no kind", "FOAM exiting", *["y"] * 9, "--> foam warning", "Cannot find required object dynamicP in", *["z"] * 9, "FOAM Warning", "cannot find required object rho", *["z"] * 9, "FOAM Warning " + "w" * 1300, "only cell interpolation can be applied", *["z"] * 9, "sigsegv"]
    log = spark.createDataFrame([("s", i, t) for i, t in enumerate(rows, 1)], "source string, line long, text string")
    got = {r.line: (r.severity, r.category, r.blocking) for r in logs.diagnose(log, log_rules.KINDS, "source").collect()}
    at = lambda t: next(i for i, x in enumerate(rows, 1) if x.startswith(t))
    assert got == {
        2: ("fatal", "boundary_condition_missing_entry", True),
        10: ("fatal", "openfoam_fatal", True),
        at("--> foam"): ("nonblocking_warning", "derived_field_unavailable", False),
        at("FOAM Warning"): ("warning", "missing_runtime_object", False),
        at("FOAM Warning w"): ("nonblocking_warning", "probe_interpolation_downgraded", False),
        len(rows): ("fatal", "openfoam_fatal", True),
    }
    message = {r.line: r.message for r in logs.diagnose(log, log_rules.KINDS, "source").collect()}
    assert message[2] == "before\n--> FOAM FATAL IO ERROR warning\nkeyword gamma is undefined\nx\nx\nx" and len(message[at("FOAM Warning w")]) == 1200


def test_glob_sequences(spark):
    import fnmatch

    from tessera.functions import text as T

    names = ["a.c", "b.c", "].c", "-.c", "!.c", "^.c", "[.c", "ab.c", "x/a.c", "\\.c"]
    for pattern in ("[ab].c", "[!ab].c", "[]a].c", "[a-c].c", "[^a].c", "[a.c", "[!]].c", "?.c"):
        rows = spark.createDataFrame([(n,) for n in names], "n string").where(f"n rlike r'{T.glob_regex(pattern)}'").collect()
        assert {r.n for r in rows} == {n for n in names if fnmatch.fnmatchcase(n.rpartition("/")[2], pattern)}, pattern


def test_bm25_shuffles_postings_of_asked_terms_only(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma") for i in range(50)], "key long, text string")
    asked = spark.createDataFrame([(1, "alpha beta3")], "item long, text string")
    plan = ranking.postings(docs, F.broadcast(asked.select(F.explode(F.split("text", " ")).alias("term"))), "key")._jdf.queryExecution().optimizedPlan().toString()
    semi = next(x for x in plan.splitlines() if "LeftSemi" in x)
    assert "broadcast" in semi


def test_bm25_tokenises_each_text_once(spark):
    """What is left of the plan after the postings are written has no text and explodes nothing."""
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma", i * 2) for i in range(50)], "key long, text string, place long")
    asked = spark.createDataFrame([(1, "alpha beta3")], "item long, text string")
    best = ranking.bm25(docs, asked, "key", "item", keep=("place",))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "text" not in plan
    assert best.columns == ["item", "key", "place", "score", "rank"] and all(r.place == 2 * r.key for r in best.collect())
    written = ranking.postings(docs, asked.select(F.lit("alpha").alias("term")), "key")._jdf.queryExecution().optimizedPlan().toString()
    assert written.count("Generate") == 1


def test_walk_goes_by_decay(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "y"), ("d", "a", "one"), ("a", "e", "no")], "source string, target string, relation string")
    decay = spark.createDataFrame([("x", 0.6), ("y", 0.2), ("one", 0.5)], "relation string, factor double")
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "z", -1.0), (2, "a", 0.0)], "q long, node string, score double")
    got = {(r.q, r.node): r.mass for r in graphs.restart_walk(seeds, edges, decay, "q", rounds=1, forward=("one",)).collect() if r.mass}
    assert got == {(1, "a"): pytest.approx(0.35), (1, "b"): pytest.approx(0.65 * 0.75), (1, "c"): pytest.approx(0.65 * 0.25)}


def test_closure_ends_or_fails(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "source long, target long")
    roots = spark.createDataFrame([(0,)], "root long")
    assert graphs.closure(roots, chain, 10).count() == 10
    with pytest.raises(RuntimeError):
        graphs.closure(roots, chain, 3)


def test_numeric_grades_and_aliases(spark):
    rows = [
        ("numeric", "FINAL: 1.05", "answered", "1", 0.1, 0.0, None),
        ("numeric", "FINAL: 105", "answered", "100", 0.0, 0.05, None),
        ("numeric", "FINAL: 1.05", "answered", "1", None, None, None),
        ("numeric", "FINAL: １００", "answered", "100", None, None, None),
        ("numeric", "FINAL: 1e5 m", "answered", "100000", None, None, None),
        ("fill", "FINAL: `ﬁeld`", "answered", "x", None, None, ["field"]),
        ("fill", "FINAL: é漢", "answered", "é漢", None, None, []),
        ("fill", "FINAL: two words", "answered", "two words", None, None, None),
    ]
    df = spark.createDataFrame(rows, "kind string, answer string, status string, gold string, absolute_tolerance double, relative_tolerance double, aliases array<string>")
    assert [r.reason for r in evaluation.grade(df).collect()] == ["correct", "correct", "wrong_answer", "correct", "invalid_final_format", "correct", "correct", "invalid_final_format"]


def test_parsers(spark):
    got = {e["path"]: (e["value"], e["status"]) for e in parse_dictionary("c4 { rho 1; rho 2; }\ndiv(phi,U) Gauss upwind;\nx $y;\nendTime 0.1 // c\n")}
    assert got["c4/rho@2"] == ("2", "unresolved") and got["c4/rho"][1] == "unresolved"
    assert got["div(phi,U)"] == ("Gauss upwind", "ok") and got["x"][1] == "unresolved" and got["endTime"] == ("0.1", "missing_semicolon")
    docs = spark.createDataFrame([("m", "# A\n```\n# no\n```\n## B ##\n"), ("n", None)], "id string, text string")
    assert [(r.line, r.level, r.title) for r in markdown_headings(docs, "id").collect()] == [(1, 1, "A"), (5, 2, "B")]
    inc = spark.createDataFrame([("a", '#include "b"\n// #include "c"\n#include "../d"\n#include "$e"')], "id string, text string")
    assert [r.target for r in include_edges(inc, "id").collect()] == ["b"]
    assert dictionary_entries(docs, keep=("id",)).where("id = 'n'").count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([], "item_id long, text string")
    units = ranking.passages(docs)
    assert ranking.bm25(units, asked, "passage_id", "item_id").count() == 0
    assert ranges.merge_ranges(spark.createDataFrame([], "path string, start long, end long"), ["path"]).count() == 0
