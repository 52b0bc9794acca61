"""Terms counted and units ranked task by task, against the plans that shuffle postings."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import lexical, ranking

PARTS = ["a", "the", "A", "BC", "foo", "Bar", "9", "12", "_", " ", "\n", ".", "-", "é", "ß", "漢", "字", "中", "𝒳", "İ", "K", "㐀", "\x00", "ABC", "x1", "\t", "ü"]


def made(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", "ABC", "fooA", "12", "9ab", "漢", "漢字中", "a the"]


def test_counts_are_those_of_tokens(spark, monkeypatch):
    texts = made(1500)
    rows = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i").select(tokens(F.col("s")).alias("t")).collect()]
    terms = {x: i for i, x in enumerate(sorted({x for r in rows for x in r}))}
    names = list(terms)
    monkeypatch.setattr(lexical, "REMEMBERED", 50)
    length, at, ids, tfs = lexical.Counter(terms).count(pa.array(["beside", *texts])[1:])
    found = [Counter() for _ in texts]
    for k, i, n in zip(at, ids, tfs, strict=True):
        found[k][names[i]] += int(n)
    assert found == [Counter(r) for r in rows] and length.tolist() == [len(r) for r in rows]


def test_bm25_shuffles_no_pairs_and_equals_the_plan_that_does(spark, monkeypatch):
    """q13_bm25: postings and pairs of query and unit were shuffled, 7 times the input's bytes."""
    texts = made(700)
    units = spark.createDataFrame([(f"k{i}", t, i % 7) for i, t in enumerate([None, *texts])], "key string, text string, place int")
    asked = spark.createDataFrame([(i, texts[i * 7]) for i in range(40)] + [(None, "foo bar"), (3, "foo foo foo"), (900, "nowhere")], "item long, text string")
    for name, few in (("TEXT_BYTES", 300), ("PRODUCTS", 50), ("HELD", 40)):
        monkeypatch.setattr(lexical, name, few)
    seen, before = Observation(), Observation()
    best = ranking.bm25(units, asked, "key", "item", 5, keep=("place",), work=seen)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = sorted(map(tuple, best.collect()), key=str)
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 10)
    other = ranking.bm25(units, asked, "key", "item", 5, keep=("place",), work=before)
    assert "Join" in other._jdf.queryExecution().optimizedPlan().toString()
    assert got == sorted(map(tuple, other.collect()), key=str) and len(got) > 100
    assert seen.get == before.get and seen.get["bm25_posting_visits"] > 0


def test_units_with_one_key_are_summed(spark):
    units = spark.createDataFrame([("x", "alpha beta"), ("x", "alpha gamma delta"), ("y", "alpha alpha alpha")], "key string, text string")
    asked = spark.createDataFrame([(1, "alpha")], "item long, text string")
    assert [(r.key, r["rank"]) for r in ranking.bm25(units, asked, "key", "item").orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def test_rows_passed_on_early_lose_nothing():
    rows = pa.RecordBatch.from_arrays([pa.array([f"k{i:03}" for i in range(200)])], ["key"])
    score = [round(random.Random(i).random(), 1) for i in range(200)]
    for held in (10, 10_000):
        lexical.HELD, was = held, lexical.HELD
        try:
            best = lexical.Best(3, 2, "key")
            out = [t for a in range(0, 200, 20) for t in best.add(np.arange(20) % 2, np.array(score[a : a + 20]), np.arange(a, a + 20), rows)]
            out += best.rest()
        finally:
            lexical.HELD = was
        found = pa.concat_tables(out).to_pylist()
        for q in (0, 1):
            expected = sorted(((-score[i], f"k{i:03}") for i in range(200) if i % 2 == q))[:3]
            assert sorted((-r["score"], r["key"]) for r in found if r["_q"] == q)[:3] == expected


def test_literals_shuffle_no_pairs_and_equal_the_plan_that_does(spark, monkeypatch):
    """q15_hybrid: finds of literals and pairs of query and unit were shuffled."""
    r = random.Random(3)
    parts = [*PARTS, "foo.b", "a/", "x-1", "src1", "c.", "́", "‍", "½", "²", "‿"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(600)]
    rows = [(f"k{i}", t, r.choice(["src1/foo.b", "x", "a/", "", None])) for i, t in enumerate([None, *texts])]
    units = spark.createDataFrame(rows, "key string, text string, place string")
    asked = spark.createDataFrame([(i, texts[i * 7]) for i in range(40)] + [(None, "foo BC."), (3, "foo foo src1")], "item long, text string")
    for name, few in (("TEXT_BYTES", 300), ("PRODUCTS", 50), ("HELD", 40)):
        monkeypatch.setattr(lexical, name, few)
    for path in (None, "place"):
        best = ranking.literal_hits(units, asked, "key", "item", 5, path=path)
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        with monkeypatch.context() as m:
            m.setattr(ranking, "BROADCAST_TERMS", 10)
            other = ranking.literal_hits(units, asked, "key", "item", 5, path=path)
            assert sorted(map(tuple, best.collect()), key=str) == sorted(map(tuple, other.collect()), key=str) and best.count() > 100 and best.schema == other.schema


def test_facets_are_read_of_hits_only(spark):
    """q27_facet_greedy: the terms of all passages were shuffled, 3.5 times the input's bytes."""
    from tessera.functions.text import terms
    from tessera.plans import catalog, common

    folder = "/root/testdata/sf0.001"
    found = catalog.QUERIES["q27_facet_greedy"](spark, folder)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2
    words = {r.passage_id: set(r.t) for r in ranking.passages(common.texts(spark, folder)).select("passage_id", terms(F.col("text")).alias("t")).collect()}
    asked = {r.item_id: set(r.t) for r in common.table(spark, folder, "benchmark").select("item_id", terms(F.col("text")).alias("t")).collect()}
    pools, expected = {}, set()
    for r in common.item_hits(spark, folder).collect():
        pools.setdefault(r.item_id, []).append((-r.score, r.passage_id, r.doc_id))
    for item, pool in pools.items():
        rest, seen, paths = sorted(pool), set(), Counter()
        for place in range(1, 11):
            if rest:
                new = [len(words[p] & asked[item] - seen) for _, p, _ in rest]
                k = max(range(len(rest)), key=lambda k: (-rest[k][0] * (1 + new[k]) / (1 + 0.25 * paths[rest[k][2]]), -k))
                _, p, doc = rest.pop(k)
                seen |= words[p] & asked[item]
                paths[doc] += 1
                expected.add((item, p, place))
    assert {(r.item_id, r.passage_id, r.place) for r in found.collect()} == expected
