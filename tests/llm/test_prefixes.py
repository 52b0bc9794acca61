"""Pairs by rare shingles of full sets, and large keys, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neardup


def test_no_pair_across_components_is_missing(spark):
    rng = random.Random(6)
    common, sets = list(range(40)), {}
    for k in range(120):
        base = rng.sample(common, rng.randrange(5, 40)) if k % 2 else sorted(sets[rng.randrange(k)]["s"] - {rng.randrange(40)}) if k > 4 else common
        sets[k] = {"c": rng.randrange(6), "s": set(base) | {1000 + rng.randrange(5_000) for _ in range(rng.randrange(3))}}
    rows = [(k, v["c"], len(v["s"]), sorted(v["s"])) for k, v in sets.items()]
    lanes = [(k, [0] * neardup.LANES) for k in sets]
    fits = (F.col("c_a") < F.col("c_b")) & (100 * F.least("n_a", "n_b") >= 80 * F.greatest("n_a", "n_b"))
    found = neardup.prefix_pairs(spark.createDataFrame(rows, "id long, c long, n int, s array<long>"), spark.createDataFrame(lanes, "id long, lanes array<long>"), fits, 80, 60)
    got = {(r.a, r.b) for r in found.collect()}
    need = {(a, b) for a in sets for b in sets if sets[a]["c"] < sets[b]["c"] and 100 * len(sets[a]["s"] & sets[b]["s"]) >= 80 * len(sets[a]["s"] | sets[b]["s"])}
    assert len(need) > 20 and need <= got
    assert all(sets[a]["c"] < sets[b]["c"] for a, b in got)


def test_large_keys_equal_brute_force(spark, monkeypatch):
    """With no small keys, the last step pairs by shingles alone."""
    monkeypatch.setattr(neardup, "SMALL_KEY", 0)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    rng = random.Random(2)
    base = [f"w{rng.randrange(60)}" for _ in range(90)]
    texts = [" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(9)}" for w in base) for _ in range(40)] + ["lone text of its own with some words"]
    own = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=4, max_distance=60).collect()}
    assert got == dict(enumerate(root)) and np.unique(root).size > 2
