"""Each query against its SQL on the smallest tables."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, FOLDER)
    result = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    expected = Counter(tuple(map(plain, r)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in found.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_hybrid_equals_brute_force(spark):
    import re

    from tessera.operators import ranking
    from tessera.plans import common, retrieval

    lexical = [(r.item_id, r.passage_id, r["rank"]) for r in common.item_hits(spark, FOLDER).collect()]
    dense = [(r.item_id, r.doc_id, r["rank"]) for r in retrieval._dense(spark, FOLDER).collect()]
    source = {r.doc_id: r.source for r in common.table(spark, FOLDER, "documents").collect()}
    units = {r.passage_id: r for r in ranking.passages(common.texts(spark, FOLDER)).collect()}
    firsts = {}
    for u in units.values():
        if u.start == 1:
            firsts[u.doc_id] = min(firsts.get(u.doc_id, u.passage_id), u.passage_id)
    items = {r.item_id: r.text for r in common.table(spark, FOLDER, "benchmark").collect()}
    lists = [lexical, [(i, firsts[x], k) for i, x, k in dense if x in firsts], []]
    words = {p: set(re.findall(r"\w+", u.text)) for p, u in units.items()}
    for item, text in items.items():
        exact = re.findall(r"[A-Za-z_][A-Za-z_0-9./-]*", text or "")
        scores = {}
        for p, u in units.items():
            n = sum(4 if t in source[u.doc_id] else 1 for t in exact if t in source[u.doc_id] or (re.match(r"\w+", t)[0] in words[p] and re.search(r"(?<!\w)" + re.escape(t) + r"(?!\w)", u.text)))
            if n:
                scores[p] = n
        lists[2] += [(item, p, k) for k, p in enumerate(sorted(scores, key=lambda p: (-scores[p], p))[:64], 1)]
    fused = {}
    for ranked in lists:
        for item, p, k in ranked:
            fused.setdefault(item, Counter())[p] += 1 / (60 + k)
    seen = {(i, p) for i, p, k in lexical if i % 2 == 0 and k <= 3}
    expected = set()
    for item, scores in fused.items():
        taken = []
        for p in sorted(scores, key=lambda p: (-round(scores[p], 9), p)):
            u = units[p]
            below = any(f"{source[u.doc_id]}/{u.doc_id}".startswith(s) for s in ("src1/", "src2/"))
            if (item, p) in seen or item % 3 == 0 and not below:
                continue
            if all(u.doc_id != t.doc_id or max(0, min(u.end, t.end) - max(u.start, t.start) + 1) <= 0.75 * min(u.end - u.start + 1, t.end - t.start + 1) for t in taken):
                taken.append(u)
            if len(taken) == 32:
                break
        expected |= {(item, t.passage_id) for t in taken}
    assert {(r.item_id, r.passage_id) for r in catalog.QUERIES["q15_hybrid"](spark, FOLDER).collect()} == expected
