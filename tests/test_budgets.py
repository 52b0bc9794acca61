"""Shrinking excerpts, reviews, resampling and facet choices against brute force."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import budgets, evaluation, ranking
from tessera.plans import catalog, runs

FOLDER = "/root/testdata/sf0.001"


def wire(fixed, items):
    return fixed + sum(len(json.dumps(t, ensure_ascii=False)) + (not whole) for t, whole in items.values())


def shrunk(fixed, texts, budget):
    items = {k: (t, True) for k, t in texts.items()}
    while (size := wire(fixed, items)) > budget:
        open_ = [k for k in sorted(items) if items[k][0]]
        if not open_:
            return None
        k = max(open_, key=lambda k: len(items[k][0]))
        text = items[k][0]
        items[k] = (text[: len(text) - min(len(text), size - budget + 20)], False)
    return items


def test_shrunk_excerpts_equal_the_loop(spark):
    rng = random.Random(5)
    packets = {q: (rng.randrange(20, 200), {k: "".join(rng.choice(['a', 'é', '"', "\n", "b"]) for _ in range(rng.randrange(300))) for k in range(rng.randrange(1, 6))}) for q in range(120)}
    rows = [(q, k, t) for q, (_, texts) in packets.items() for k, t in texts.items()]
    got = defaultdict(dict)
    found = budgets.shrunk_excerpts(spark.createDataFrame(rows, "q int, place int, text string"), spark.createDataFrame([(q, f) for q, (f, _) in packets.items()], "q int, chars int"), "q", 180)
    for r in found.collect():
        got[r.q][r.place] = (r.text, r.complete)
    for q, (fixed, texts) in packets.items():
        expected = shrunk(fixed, texts, 180)
        assert got[q] == ({None: (None, False)} if expected is None else expected), q


def test_shrunk_query_equals_the_loop(spark):
    texts = defaultdict(dict)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        texts[r.conv_id][r.turn] = r.text or ""
    got = defaultdict(dict)
    for r in runs.q147(spark, FOLDER).collect():
        got[r.conv_id][r.place] = (r.text, r.complete)
    for q, own in texts.items():
        assert got[q] == (shrunk(40 + 30 * len(own), own, 600) or {None: (None, False)})


def test_reviews_are_whole_and_paired(spark):
    schema = "session string, arm string, item string, ok boolean, reviewed boolean, citation double, answer double"
    rows = [("Q1-p1", "a", "Q1", True, True, 1.0, 1.0), ("Q1-p2", "a", "Q1", True, True, 1.0, None), ("Q1-p1", "b", "Q1", True, True, 1.0, 1.0), ("Q1-p2", "b", "Q1", False, True, 0.5, 1.0)]
    df = spark.createDataFrame(rows, schema)
    assert budgets.checked_reviews(df, "session", "arm", "session", "reviewed").count() == 4
    assert {(r.arm, r.outcome) for r in budgets.rewrite_consistency(df, "arm", "item", "ok").collect()} == {("a", "all_success"), ("b", "mixed_success")}
    only = budgets.citation_only_failures(df, "ok", F.col("citation"), [F.col("answer")])
    assert [(r.session, r.arm) for r in only.collect()] == [("Q1-p2", "b")]
    for change, why in (((*rows[0][:4], False, 1.0, 1.0), "explicit review"), (rows[1], "duplicate"), (("Q2-p1", *rows[0][1:]), "same questions")):
        with pytest.raises(Exception, match=why):
            budgets.checked_reviews(spark.createDataFrame([change, *rows[1:]], schema), "session", "arm", "session", "reviewed").collect()


def test_bootstrap_equals_resampling_by_hand(spark):
    rng = random.Random(3)
    values = [(f"c{k:02}", rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0])) for k in range(12) for _ in range(rng.randrange(1, 6))]
    draws = evaluation.resamples(spark, 12, 300)
    found = evaluation.cluster_bootstrap(spark.createDataFrame(values, "c string, v double"), "c", "v", draws).first()
    times = defaultdict(dict)
    for r in draws.collect():
        times[r.resample][r.cluster] = r.times
    assert len(times) == 300 and all(sum(t.values()) == 12 for t in times.values())
    own = defaultdict(list)
    for c, v in values:
        own[c].append(v)
    clusters = [own[c] for c in sorted(own)]
    stats = []
    for t in times.values():
        drawn = [v for k, n in t.items() for v in clusters[k] * n]
        stats.append((round(sum(map(abs, drawn)) / len(drawn), 9), round(sum(drawn) / len(drawn), 9)))
    at = lambda i, p: sorted(s[i] for s in stats)[int(p * (len(stats) - 1))]
    assert (found.mae_low, found.mae_high, found.bias_low, found.bias_high, found.resamples) == pytest.approx((at(0, 0.025), at(0, 0.975), at(1, 0.025), at(1, 0.975), 300))


def test_facets_equal_a_greedy_choice(spark):
    rng = random.Random(8)
    rows = [(q, f"k{k:02}", rng.choice("xyz"), round(rng.random() * 4, 3), rng.sample("abcdef", rng.randrange(4))) for q in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "q int, key string, path string, score double, facets array<string>")
    got = {(r.q, r.place): r.key for r in ranking.facet_greedy(df, "q", "key", "path", keep=8, size=30).collect()}
    for q in range(4):
        pool = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))[:30]
        seen, paths = set(), Counter()
        for place in range(1, 9):
            best = min(pool, key=lambda r: (-r[3] * (1 + len(set(r[4]) - seen)) / (1 + 0.25 * paths[r[2]]), r[1]))
            assert got[q, place] == best[1], (q, place)
            pool.remove(best)
            seen |= set(best[4])
            paths[best[2]] += 1


def test_entries_of_styles_equal_a_walk(spark):
    """Flat rules of style sheets: what stands before a colon within braces."""
    import re

    got = defaultdict(list)
    for r in catalog.QUERIES["q39_markup_entries"](spark, FOLDER).collect():
        got[r.page_id].append((r.path, r.kind))
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    for p in pages:
        styles = "\n".join(re.findall(r"(?s)<style>(.*?)</style>", p.html or ""))
        blocks = [x.strip() for x in re.findall(r"([^{};]*)\{", re.sub(r"(?s)/\*.*?\*/|//[^\n]*", "", styles))]
        assert sum(kind == "block" for _, kind in got[p.page_id]) == len(blocks)
