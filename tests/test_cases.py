"""Case texts, targets, states and ways against rules written out by hand; pairing as a stream."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import case_text as C
from tessera.functions import json_text as J
from tessera.operators import cases, structure
from tessera.streaming import streams


def test_ten_digits(spark):
    values = [0.0, 1.0, 0.1, -2.5, 1e-4, 9.9999999999e-5, 1e10, 9999999999.0, 99999999999.0, 1.8e-5, 123456.789012345, 1e300, -1e-300, 5e-05, 100.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", C.ten_digits(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.v:.10g}" for r in rows]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "v double").select(C.ten_digits(F.col("v")).alias("t"))
    assert [r.t for r in odd.collect()] == ["nan", "inf", "-inf", None]


def python_block(text, name, cap):
    import re

    m = re.search(rf"(?m)^\s*{re.escape(name)}\s*\{{", text)
    if not m:
        return ""
    at = text.find("{", m.start())
    depth, end = 0, at
    for k in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if depth == 0:
            end = k + 1
            break
    found = text[m.start() : end]
    return found[:cap] + "..." if len(found) > cap else found


def test_blocks_equal_a_walk_over_characters(spark):
    import random
    import re

    rng = random.Random(4)
    parts = ["functions", "boundaryField", "boundary", "{", "}", "\n", "\n    ", "    ", " ", "a", "b.c", "{}", "\ntype x;", "type y ;", "functions\n{\n", "boundaryField {\n    in {"]
    texts = ["a { b }", None, "\n\n  functions\n{ a\n    {}\n}", "functions { x", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = df.select("k", C.block(F.col("t"), "functions", 30, "...").alias("b"), C.function_names(F.col("t")).alias("f"), C.boundary_types(F.col("t"), 3).alias("y")).collect()
    for r in rows:
        text = texts[r.k] or ""
        assert r.b == python_block(text, "functions", 30), repr(text)
        names = re.findall(r"(?m)^\s{4,}([A-Za-z_][A-Za-z0-9_.-]*)\s*$\n\s{4,}\{", python_block(text, "functions", 5000))
        assert r.f == list(dict.fromkeys(names))
        held, kinds = python_block(text, "boundaryField", 6000) or python_block(text, "boundary", 6000), []
        for m in re.finditer(r"(?m)^\s{4,}([A-Za-z_][A-Za-z0-9_.-]*)\s*\{", held):
            kind = re.search(r"(?m)^\s*type\s+([^;]+);", held[m.end() : m.end() + 500])
            kinds.append(f"{m[1]}: {kind[1].strip()}" if kind else m[1])
        assert r.y == kinds[:3], repr(text)


TARGETS = [
    ("比热比为1.5的气体", "unique"), ("比热比(gamma)为1.50", "unique"), ("heat capacity ratio of 1.5", "unique"), ("gamma=1.5 gamma is 1.50", "unique"), ("gamma=1.6", "no_match"),
    ("gamma>1.4", "unsupported_or_conflicting_predicate"), ("比热比不是1.5", "unsupported_or_conflicting_predicate"), ("gamma=1.4 gamma=1.5", "unsupported_or_conflicting_predicate"), ("As=1.5e-6 Ts=120", None),
    ("比热比为1.5的气体改用sutherland；目标气体其余的比热比、热力学和状态方程设置也保持原样。", "unique"), ("Keep gamma and other settings unchanged.", None), ("gamma=1.5;gamma=1.4保持不变", "unsupported_or_conflicting_predicate"),
    ("gamma=1.5;keep gamma higher than 1.4 unchanged", "unsupported_or_conflicting_predicate"), ("gamma=1.5;比热比较大的保持原样", "unsupported_or_conflicting_predicate"), ("比热比为1.5; heat capacity ratio 1.4", "unsupported_or_conflicting_predicate"), (None, None),
]


def test_attribute_targets(spark):
    asked = spark.createDataFrame([(k, "demo", t) for k, (t, _) in enumerate(TARGETS)], "k int, c string, text string")
    seen = spark.createDataFrame([("demo", "first", "1.5"), ("demo", "second", "1.4")], "c string, target string, value string")
    aliases = ["gamma", "比热比", "heat capacity ratio"]
    got = {r.k: (r.status, r.target) for r in cases.attribute_targets(asked, seen, "k", "c", aliases).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: s for k, (_, s) in enumerate(TARGETS) if s}
    assert {v[1] for v in got.values() if v[0] == "unique"} == {"first"}
    both = cases.attribute_targets(asked.where("k = 0"), seen.withColumn("value", F.lit("1.50")), "k", "c", aliases).first()
    lost = cases.attribute_targets(asked.where("k = 0"), seen.withColumn("value", F.when(F.col("target") == "first", "1.5").otherwise("$x")), "k", "c", aliases).first()
    assert (both.status, both.target, lost.status, lost.target) == ("ambiguous", None, "unresolved_source", None)


def test_parameter_rows_state_only_their_own(spark):
    text = "# M\n\n| Entry | Description | Default | Required |\n|---|---|---|---|\n| name | Name | none | no |\n| $T_{ref$ | Value | - | if active |\n\n| Model | Description |\n|---|---|\n| m | Is a model |\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = [(r.k, r.line, r.identifiers, r.defaults, r.requirements) for r in cases.parameter_rows(df, "k", "t").collect()]
    assert sorted(got) == [(1, 5, ["name"], ["Default: none"], ["Required: no"]), (1, 6, [], [], ["Required: if active"])]


def test_constants_that_are_not_known(spark):
    rows = [(1, "const", "0"), (1, "const", "nan"), (2, "const", "0"), (2, "const", None), (3, "const", "1e999"), (4, "const", "0"), (4, "const", "0.0"), (5, "const", "-1"), (5, "const", "2")]
    got = {r.c: r.state for r in cases.constant_state(spark.createDataFrame(rows, "c int, kind string, value string"), "c").collect()}
    assert got == {1: "unknown", 2: "unknown", 3: "unknown", 4: "all_const_zero", 5: "positive_const_input"}


def test_ways_end_in_cycles_and_raise_beyond_the_depth(spark):
    edges = spark.createDataFrame([("a", "b", "CALL", "accept"), ("b", "c", "CALL", "accept"), ("b", "a", "CALL", "accept"), ("a", "c", "SUMMARY", "accept"), ("c", "d", "CALL", "pending")], "source string, target string, relation string, review string")
    start = spark.createDataFrame([("a",)], "source string")
    way = lambda *kinds: {r.target: r.path for r in cases.reviewed_paths(start, edges, list(kinds) or None).collect()}
    assert way() == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"]}
    assert way("CALL") == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"]}
    with pytest.raises(RuntimeError):
        cases.reviewed_paths(start, edges, ["CALL"], 2)


def test_fences_of_both_kinds(spark):
    text = "a\n```\n~~~\n# no\n```\nb\n~~~\nc"
    df = spark.createDataFrame([(text,), (None,)], "t string").select(structure.fenced(F.col("t")).alias("f"))
    assert [[x.code for x in r.f] for r in df.collect()] == [[False, True, True, True, True, False, True, True], [False]]


def test_pairs_of_a_stream_come_once_both_have(spark, tmp_path):
    schema = "task long, ts timestamp, value double"
    write = lambda side, rows: spark.createDataFrame(rows, "task long, t string, value double").selectExpr("task", "cast(t as timestamp) ts", "value").write.mode("append").parquet(f"file://{tmp_path}/{side}")

    def run():
        a, b = (spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{s}") for s in "ab")
        out = streams.paired(a, b, "task").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        out.awaitTermination()
        return sorted(map(tuple, spark.read.schema("task long, mean double").parquet(f"file://{tmp_path}/out").collect()))

    write("a", [(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:00:00", 4.0)])
    write("b", [(1, "2024-01-02 00:00:00", 3.0), (3, "2024-01-02 00:00:00", 3.0)])
    assert run() == [(1, 2.0)]
    write("b", [(2, "2024-01-03 00:00:00", 0.0)])
    assert run() == [(1, 2.0), (2, 2.0)]


def test_json_of_models(spark):
    wrapped = '{"type": "json_object", "content": "{\\"action\\": \\"search\\"}"}'
    rows = [('{"a": 1}', None, '{"a":1}'), ('{"a": 1}\n{"b": 2}', "not_json", '{"a":1}'), ('{"a": "x\ny"}', "not_json", '{"a":"x\\ny"}'), (wrapped, None, '{"action":"search"}'), ("[1]", None, None), ("", "empty", None), (None, "empty", None), ('{"a": {"b": 1, "b": 1}}', "duplicate_key", '{"a":{"b":1}}'), ("x {}", "not_json", None), ('{"type": "json_object", "content": {"a": 1}, "z": 1}', None, '{"content":{"a":1},"type":"json_object","z":1}')]
    got = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "k int, t string").select("k", J.json_fault(F.col("t")).alias("f"), J.json_prefix(F.col("t")).alias("p")).collect()
    assert [(r.f, r.p) for r in sorted(got)] == [(f, p) for _, f, p in rows]
