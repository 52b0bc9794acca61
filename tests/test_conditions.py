"""Conditions in scores and routes, variants, and scopes that questions state."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import identity, routing

NODES = [("n1", "alpha text", "", "p", "", "", None, "only with gamma and delta and beta"), ("n2", "alpha text", "", "p", "", "", None, None), ("n3", "other", "", "p", "", "", None, "alpha gamma")]


def test_conditions_add_to_scores_and_do_not_find_nodes(spark):
    nodes = spark.createDataFrame(NODES, "node string, text string, headings string, path string, identity string, key string, case string, conditions string")
    asked = spark.createDataFrame([(1, "alpha gamma delta beta", None)], "q int, question string, cases array<string>")
    plain = {r.node: r.score for r in routing.facet_scores(nodes, asked).collect()}
    more = {r.node: r.score for r in routing.facet_scores(nodes, asked, conditions="conditions").collect()}
    assert set(plain) == set(more) == {"n1", "n2"} and plain["n1"] == plain["n2"]
    assert more == {"n1": plain["n1"] + 2, "n2": plain["n2"]}


def test_conditions_of_edges_and_variants(spark):
    edges = spark.createDataFrame([("a", "b", "r", False, "gamma delta beta alpha"), ("a", "c", "r", True, None), ("d", "a", "r", False, "gamma")], "source string, target string, relation string, cross boolean, conditions string")
    asked = spark.createDataFrame([(1, "alpha gamma delta beta"), (2, "nothing")], "q int, question string")
    bonus = routing.condition_bonus(asked, edges, "q")
    assert {(r.q, r.source, r.target): r.plus for r in bonus.collect()} == {(1, "a", "b"): 3, (1, "d", "a"): 1}
    rules = spark.createDataFrame([("r", 0.5, 1.0, 0.25, True)], "relation string, factor double, bonus double, cross_bonus double, backward boolean")
    seeds = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0)], "q int, node string, score double")
    scores = lambda e, b=None, depth=1: {(r.q, r.node): r.score for r in routing.routes(seeds, e, rules, "q", depth, bonus=b).collect()}
    assert scores(edges, bonus) == {(1, "a"): 2.0, (1, "b"): 5.0, (1, "c"): 1.25, (1, "d"): 3.0, (2, "a"): 2.0, (2, "b"): 2.0, (2, "c"): 1.25, (2, "d"): 2.0}
    for variant, left in (("full", {"a", "b", "c", "d"}), ("no_cross", {"a", "b", "d"}), ("no_conditions", {"a", "b", "c", "d"}), ("no_extension", {"a"})):
        nodes, kept, depth = routing.ablated(edges.select("source"), edges, variant)
        found = scores(kept, routing.condition_bonus(asked, kept, "q"), 1 if depth is None else depth)
        assert {n for _, n in found} == left and (variant != "no_conditions" or found[1, "b"] == 2.0)
    with pytest.raises(ValueError):
        routing.ablated(edges, edges, "other")


def test_sources_that_a_question_leaves(spark):
    rows = [("手册怎么说", "tutorials/a", False, False), ("手册怎么说", "manual/a", False, True), ("手册和教程", "tutorials/a", False, True), ("手册", "tutorials/a", True, True), ("只查教程", "manual/a", False, False), ("仅查教程", "tutorials/a", None, True), (None, "manual/a", None, True)]
    df = spark.createDataFrame(rows, "q string, path string, named boolean, ok boolean")
    got = df.select(identity.source_allowed(F.col("q"), F.col("path"), F.col("named")).alias("got"), "ok").collect()
    assert all(r.got == r.ok for r in got)


@pytest.mark.parametrize("rare", [0, 2, 1_000])
def test_most_shared_terms_by_rare_terms_first(spark, monkeypatch, rare):
    import random

    monkeypatch.setattr(routing, "RARE", rare)
    rng = random.Random(rare)
    words = [f"w{k}" for k in range(12)]
    names = sorted({" ".join(rng.choice(words[: rng.choice([3, 12])]) for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    asked = {q: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for q in range(80)} | {80: "unknown", 81: None, 82: names[3]}
    got = routing.resolved(spark.createDataFrame(list(asked.items()), "q int, text string"), spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([("w1", names[5])], "alias string, name string"), "q")
    for r in got.collect():
        text = asked[r.q]
        if text in names:
            assert (r.name, r.how) == (text, "exact")
        elif text == "w1":
            assert (r.name, r.how) == (names[5], "alias")
        else:
            shared = {n: len(set(n.split()) & set((text or "").split())) for n in names}
            best = min((n for n in names if shared[n]), key=lambda n: (-shared[n], n), default=None)
            assert r.name == best and (r.how == "terms") == (best is not None)


def test_lexical_seeds_by_hand(spark):
    """Each channel of the score against a walk over all questions and nodes."""
    import random
    import re

    rng = random.Random(4)
    words = ["alpha", "beta", "p.rgh", "gas/mu", "tutorials/a/x", "a/x", "mu", "Model1", "手册", "教程", "压力", "1.5", "压", "control"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    nodes = [(k, text(8), rng.choice(["gas/mu", "FoamFile/x", "", None]), rng.choice(["mu", "alpha", None]), rng.choice(["tutorials/a/x", "tutorials/b/control", "manual/a/x"]), rng.choice(["Model1", None]), text(5), rng.choice(["a", "b", None]), rng.random() < 0.3) for k in range(60)]
    asked = [(q, text(7), rng.choice([[], ["a"], None])) for q in range(25)]
    df = spark.createDataFrame(nodes, "node int, text string, dictionary string, key string, path string, model string, conditions string, case string, fact boolean")
    questions = spark.createDataFrame(asked, "q int, question string, cases array<string>")
    lits = {r.q: [x.lower() for x in r.l] for r in questions.select("q", identity.literals(F.col("question")).alias("l")).collect()}

    def terms(t):
        t = (t or "").lower()
        found = set(re.findall(r"[a-z_][a-z0-9_]*|\d+(?:\.\d+)*", t))
        for run in re.findall(r"[㐀-鿿]+", t):
            found |= {run[i : i + 2] for i in range(len(run) - 1)} or {run}
        return found

    expected = {}
    for q, question, cases in asked:
        qt, cases = terms(question), cases or []
        pieces, slashed = {p for v in lits[q] for p in v.split("/")} - {""}, [v for v in lits[q] if "/" in v]
        for k, body, dictionary, key, path, model, conditions, case, fact in nodes:
            manual_only = "手册" in question and "教程" not in question and not cases
            if (dictionary or "").startswith("FoamFile") or cases and case and case not in cases or manual_only and path.startswith("tutorials/"):
                continue
            nt = terms(body)
            n = len(qt & nt)
            full = bool(dictionary) and dictionary.lower() in [v for v in slashed if not v.startswith(("manual/", "tutorials/"))]
            file = path.split("/")[-1].lower() in pieces or any(path.lower() == v or path.lower().endswith("/" + v) for v in slashed)
            flags = (full, 30), (bool(key) and key.lower() in pieces, 16), (file, 24), (bool(model) and model.lower() in pieces, 20)
            if n or any(f for f, _ in flags):
                score = 12 * n / max(1, len(qt)) + 4 * n / max(1, len(nt)) + sum(w for f, w in flags if f)
                expected[q, k] = pytest.approx(score + min(4, len(qt & terms(conditions))) + 8 * (case in cases) + fact, abs=1e-5)
    got = {(r.q, r.node): r.score for r in identity.lexical_seeds(df, questions, "q").collect()}
    assert got == expected
