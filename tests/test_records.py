"""Folds, contracts and rule tables against plain Python on small rows."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import delivery, records, routing

ALLOWED = {"queued": ("running", "cancelled"), "running": ("completed", "failed", "timed_out")}


def _fold(states):
    now, refused = None, 0
    for s in states:
        s = s or ""
        if now is None or s in ALLOWED.get(now, ()):
            now = s
        else:
            refused += 1
    return now, refused


def test_transitions_in_chunks_equal_a_fold(spark):
    jobs = {
        1: ["queued", "running", "completed", "running"],
        2: ["queued", "completed", "running", "queued", "failed", "failed"],
        3: ["lost", "queued", "running"],
        4: [None, "queued"],
        5: ["queued"] + ["queued", "lost"] * 9 + ["running"] + ["running"] * 7 + ["timed_out", "queued"],
    }
    rows = [(j, k, s) for j, states in jobs.items() for k, s in enumerate(states)]
    df = spark.createDataFrame(rows, "job int, k int, state string")
    for chunk in (1, 3, 4096):
        found = routing.transitions(df, "job", "k", "state", ALLOWED, chunk)
        assert {r.job: (r.state, r.n_refused) for r in found.collect()} == {j: _fold(s) for j, s in jobs.items()}
    assert routing.transitions(df.limit(0), "job", "k", "state", ALLOWED).count() == 0


def test_score_issues_of_nulls(spark):
    schema = "sample_id string, judge_id string, status string, points array<struct<criterion_id:string,score:string>>, fact_gate string, applicability_gate string, expected array<string>, conditional boolean"
    rows = [("s", "a", "complete", [("c", "0.5")], "1", "unknown", ["c"], None), (None,) * 8, ("s", "a", "complete", [("c", "0.3"), ("c", "1")], "not_applicable", "not_applicable", ["c"], True)]
    found = [r.issues for r in records.score_issues(spark.createDataFrame(rows, schema), ("a",)).select("issues").collect()]
    assert found == [[], ["judge", "status", "identity", "points", "criteria", "gates"], ["point", "criteria", "gates", "conditional"]]


def test_delivery_keeps_to_the_cap(spark):
    import json

    texts = {1: ["a \"quoted\" line", "", "x" * 40], 2: ["tab\there", "é漢字"]}
    rows = [(7, rank, f"p{rank}", 1, len(ls), k, t) for rank, ls in texts.items() for k, t in enumerate(ls, 1)]
    df = spark.createDataFrame(rows, "q int, rank int, path string, start int, last int, number int, text string")

    def wire(units, truncated):
        return len(json.dumps({"evidence": units, "truncated": truncated}, ensure_ascii=False, separators=(",", ":")))

    def plain(cap):
        units, truncated = [], False
        for rank, ls in texts.items():
            taken = None
            for k, t in enumerate(ls, 1):
                unit = {"path": f"p{rank}", "start": 1, "end": k, "rank": rank, "lines": [*(taken["lines"] if taken else []), {"number": k, "text": t}]}
                if wire([*units, {**unit, **({"next_line": k + 1} if k < len(ls) else {})}], True) > cap:
                    truncated = True
                    break
                taken = unit
            if taken:
                units.append({**taken, **({"next_line": taken["end"] + 1} if truncated else {})})
            if truncated:
                break
        return [] if wire(units, truncated) > cap else [(u["rank"], u["end"], u.get("next_line"), truncated) for u in units]

    for cap in [60, 90, 120, *range(125, 330, 9), 1000]:
        found = sorted((r["rank"], r.end, r.next_line, r.truncated) for r in delivery.deliver_json(df, "q", cap).collect())
        assert found == plain(cap), cap


def test_rules_with_ties_and_nulls(spark):
    asks = spark.createDataFrame([(1, "Blast wave"), (2, None), (3, "wave")], "r int, text string")
    offers = spark.createDataFrame([(k, t) for k, t in enumerate(["blast/a", "blast/b", None, "wave/c", "old blast"])], "c int, text string")
    rules = [{"any": ["blast"], "wants": ["blast"], "without": ["old"], "weight": 2}, {"any": ["wave"], "wants": ["wave"], "weight": 3}, {"any": ["wave"], "wants": ["old"], "weight": -1}]
    found = routing.rule_scores(asks, offers, rules, "r", "c", 2)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2.0, 2), (1, 3, 3.0, 1), (3, 3, 3.0, 1)]


def test_facets_of_cjk_and_nulls(spark):
    nodes = spark.createDataFrame([(1, "压力场", None, None, None, None, None), (2, None, None, None, None, None, "k"), (3, "rhoEnergy", "rhoEnergy", "a/rhoEnergy", "RhoEnergy", "rhoenergy", "k")], "node int, text string, headings string, path string, identity string, key string, case string")
    asked = spark.createDataFrame([(0, "rhoEnergy 压力场", ["k"])], "q int, question string, cases array<string>")
    found = {r.node: r.score for r in routing.facet_scores(nodes, asked).collect()}
    assert found == {1: 8.0, 3: 30 + 8 + 4 + 4 + 2 + 4.0}


def test_brackets_and_alternatives(spark):
    df = spark.createDataFrame([("a(b|c)d",), ("plain",), ("(x)",), ("([)]",), ("{[(",), (None,)], "t string")
    found = df.select(T.balanced(F.col("t")).alias("b"), records.alternatives(F.col("t")).alias("a")).collect()
    assert [r.b for r in found] == [True, True, True, True, False, True]
    assert [r.a for r in found] == [["abd", "acd"], ["plain"], ["(x)"], ["([)]"], ["{[("], None]
