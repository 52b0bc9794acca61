"""Choices of evidence, containers, manuals and drafts against brute force and outcomes written out by hand."""

import random
import re
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cases, choice, detail, drafts, manual, structure
from tessera.plans import evidence

FOLDER = "/root/testdata/sf0.001"


# -- groups and bundles -------------------------------------------------


def greedy(rows, cap):
    taken, used = set(), 0
    for place, cost in sorted(rows):
        if cost is not None and used + cost <= cap:
            used += cost
            taken.add(place)
    return taken


@pytest.mark.parametrize("rounds", [0, 2, 12])
def test_greedy_equals_sequential_choice(spark, rounds):
    rng = random.Random(rounds)
    groups = {"many": [(k, rng.randrange(0, 400)) for k in range(10_000)], "few": [(0, 5), (1, 900), (2, 4)], "none": [(0, 10_001)], "null": [(0, None), (1, 1)], "worst": [(k, 1 if k % 2 else 10_001 - k // 2) for k in range(60)]}
    df = spark.createDataFrame([(g, k, c) for g, rows in groups.items() for k, c in rows], "g string, place long, cost long")
    got = defaultdict(set)
    for r in choice.greedy_under_cap(df, ["g"], "place", "cost", 10_000, rounds).collect():
        got[r.g].add(r.place)
    assert got == {g: t for g, rows in groups.items() if (t := greedy(rows, 10_000))}


def test_atomic_groups_have_no_pool(spark):
    rows = [(1, f"g{k:03}", k, 7 if k < 200 else 2, k >= 299) for k in range(300)]
    df = spark.createDataFrame(rows, "q int, g string, r int, size int, named boolean")
    seen = spark.createDataFrame([(1, "g201")], "q int, g string")
    got = {r.g for r in cases.atomic_groups(df, "q", "g", "r", "size", 6, F.col("named"), seen).collect()}
    assert got == {"g299", "g200", "g202"}


def delivered(ranked, lines, budget):
    have, used, out = set(), 0, set()
    for place, path, start, end in sorted(ranked):
        fresh = [n for n in range(start, end + 1) if n <= len(lines[path]) and (path, n) not in have]
        cost = sum(len(lines[path][n - 1]) + 1 for n in fresh)
        if fresh and used + cost <= budget:
            used += cost
            have |= {(path, n) for n in fresh}
            out |= {(place, path, n) for n in fresh}
    return out


@pytest.mark.parametrize("budget", [0, 60, 300, 5_000])
def test_bundles_are_exact_and_do_not_overlap(spark, budget):
    rng = random.Random(budget)
    lines = {p: ["".join(rng.choice("ab é") for _ in range(rng.randrange(20))) for _ in range(12)] for p in "xyz"}
    ranked = {q: [(k, rng.choice("xyz"), s := rng.randrange(1, 12), s + rng.randrange(6)) for k in range(15)] for q in range(12)}
    rows = spark.createDataFrame([(q, *r) for q, rs in ranked.items() for r in rs], "q int, place int, path string, start int, end int")
    each = spark.createDataFrame([(p, n, t) for p, ts in lines.items() for n, t in enumerate(ts, 1)], "path string, line int, text string")
    got = defaultdict(set)
    for r in choice.bundle(rows, each, "q", budget).collect():
        assert r.text == "\n".join(lines[r.path][r.start - 1 : r.end])
        pieces = {(r.place, r.path, n) for n in range(r.start, r.end + 1)}
        assert not {x[1:] for x in pieces} & {x[1:] for x in got[r.q]}
        got[r.q] |= pieces
    assert got == {q: d for q, rs in ranked.items() if (d := delivered(rs, lines, budget))}


def test_strategies_order_ranges(spark):
    ranked = spark.createDataFrame([(1, 1, "b", 5, 6), (1, 2, "a", 1, 2), (1, 3, "b", 1, 2)], "q int, place int, path string, start int, end int")
    order = lambda df: [(r.path, r.start) for r in sorted(df.collect(), key=lambda r: r.place)]
    assert order(choice.by_files(ranked, "q")) == [("b", 1), ("b", 5), ("a", 1)]
    links = spark.createDataFrame([("a", 1, 2, "c", 9, 9), ("b", 5, 6, "a", 1, 2), ("b", 1, 2, "c", 9, 9)], "path string, start int, end int, to_path string, to_start int, to_end int")
    assert order(choice.with_links(ranked, links, "q")) == [("b", 5), ("a", 1), ("b", 1), ("c", 9)]


# -- context ------------------------------------------------------------


def brute_context(seeds, units, containers, budget, ratio=0.5, hit_limit=64):
    """Breadth-first growth over neighbours in a path, from the seed and its container, in rank order."""
    by_place = {(u["path"], u["at"]): u for u in units.values()}
    out = {}
    for request, ranked in seeds.items():
        hits = {u for rank, u in ranked if rank <= hit_limit}
        for rank, seed in sorted(ranked):
            own = units[seed]
            selected = [seed]
            around = [c for c in containers if c["path"] == own["path"] and c["first"] <= own["at"] <= c["last"]]
            sized = []
            for c in around:
                members = [by_place[c["path"], k]["unit"] for k in range(c["first"], c["last"] + 1)]
                sized.append((sum(units[m]["chars"] for m in members), c["first"], members))
            for chars, _, members in sorted(sized):
                if len(members) > 1 and len(hits & set(members)) / len(members) > ratio and chars <= budget:
                    selected += [m for m in members if m != seed]
                    break
            used, queue, taken = sum(units[s]["chars"] for s in selected), deque(selected), set(selected)
            while queue:
                u = units[queue.popleft()]
                for step in (-1, 1):
                    v = by_place.get((u["path"], u["at"] + step))
                    if v and v["unit"] not in taken and not v["barrier"] and used + v["chars"] <= budget:
                        used += v["chars"]
                        taken.add(v["unit"])
                        queue.append(v["unit"])
            for t in taken:
                out.setdefault((request, t), (rank, seed))
    return out


@pytest.mark.parametrize("budget", [40, 200, 1_000])
def test_context_equals_breadth_first_growth(spark, budget):
    rng = random.Random(budget)
    units = {f"{p}{k}": dict(unit=f"{p}{k}", path=p, at=k, chars=rng.randrange(1, 60), barrier=rng.random() < 0.08) for p in "abc" for k in range(1, 80)}
    containers = [dict(container=f"{p}:{w}:{k}", path=p, first=k, last=min(79, k + w - 1)) for p in "abc" for w in (3, 7, 20) for k in range(1, 80, w)]
    seeds = {q: list(enumerate(rng.sample(sorted(units), 30), 1)) for q in range(6)}
    got = choice.grow_context(
        spark.createDataFrame([(q, r, u) for q, rs in seeds.items() for r, u in rs], "q int, rank int, unit string"),
        spark.createDataFrame([tuple(u.values()) for u in units.values()], "unit string, path string, at int, chars long, barrier boolean"),
        spark.createDataFrame([tuple(c.values()) for c in containers], "container string, path string, first int, last int"),
        "q", budget, 0.3, 25,
    )
    assert {(r.q, r.unit): (r.rank, r.seed) for r in got.collect()} == brute_context(seeds, units, containers, budget, 0.3, 25)


def test_context_query_equals_breadth_first_growth(spark):
    seeds, units, runs = (df.collect() for df in evidence.context_inputs(spark, FOLDER))
    ranked = defaultdict(list)
    for r in seeds:
        ranked[r.request].append((r["rank"], r.unit))
    docs = sorted({u.path for u in units})[:40]
    own = {u.unit: u.asDict() for u in units if u.path in docs}
    kept = {q: rs for q, rs in ranked.items() if all(u in own for _, u in rs)}
    expected = brute_context(kept, own, [r.asDict() for r in runs if r.path in docs], 1_200)
    got = {(r.request, r.unit): (r["rank"], r.seed) for r in evidence.q128(spark, FOLDER).collect() if r.request in kept}
    assert got == expected


def test_grown_lines_equal_alternating_growth(spark):
    rng = random.Random(2)
    lines = {p: ["x" * rng.choice([0, 3, 30, 90, 700]) for _ in range(rng.randrange(1, 40))] for p in range(30)}
    anchors = {p: (s := rng.randrange(1, len(t) + 1), min(len(t), s + rng.randrange(4))) for p, t in lines.items()}
    expected = {}
    for p, (start, end) in anchors.items():
        left, right, extra = start, end, 0
        while True:
            changed = False
            for side in (-1, 1):
                n = left - 1 if side < 0 else right + 1
                if 1 <= n <= len(lines[p]) and extra + len(lines[p][n - 1]) + 1 <= 200:
                    extra, changed = extra + len(lines[p][n - 1]) + 1, True
                    left, right = (n, right) if side < 0 else (left, n)
            if not changed:
                break
        expected[p] = (left, right)
    got = choice.grow_lines(
        spark.createDataFrame([(p, p, s, e) for p, (s, e) in anchors.items()], "id int, path int, start int, end int"),
        spark.createDataFrame([(p, n, t) for p, ts in lines.items() for n, t in enumerate(ts, 1)], "path int, line int, text string"),
        ["id"], 200,
    )
    assert {r.id: (r.left, r.right) for r in got.collect()} == expected


def test_named_cases(spark):
    named = spark.createDataFrame([("solverA/shared",), ("solverB/shared",), ("solverB/own",)], "case string")
    asked = spark.createDataFrame([(1, "shared alphaMeter"), (2, "solverB/shared and own"), (3, "own?"), (4, "no"), (5, None)], "q int, text string")
    got = sorted((r.q, r.mode, r["case"]) for r in choice.case_scopes(asked, named, "q").collect() if r["case"])
    assert got == [(1, "ambiguous_basename", "solverA/shared"), (1, "ambiguous_basename", "solverB/shared"), (2, "literal_path", "solverB/shared"), (3, "unique_basename", "solverB/own")]


# -- code ---------------------------------------------------------------

CODE = [None, "", "a { b\n{ /* { */ \"{ \\\" {\" } // }\n}", "}{}\n{\n{{\n}\n}}", 'x "open { ', "/* open {\n}", "a\n{\n  u \"http://x\"; // c\n}\n", "{ {\n}}", "\n\n {\n}", '"\\"', "//" * 3 + "\n{}"]


def python_mask(text):
    return re.sub(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\])*"', lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def python_braces(text):
    text = text[:-1] if text.endswith("\n") else text
    rows, stack, line, out = text.split("\n"), [], 1, Counter()
    for c in python_mask(text):
        if c == "\n":
            line += 1
        elif c == "{":
            stack.append(line)
        elif c == "}" and stack:
            start = stack.pop()
            out[max(1, start - 1) if not rows[start - 1].strip().strip("{") else start, line] += 1
    return out


def test_masks_and_brace_ranges_equal_brute_force(spark):
    rng = random.Random(6)
    texts = CODE + ["".join(rng.choice(["{", "}", "\n", '"', "//", "/*", "*/", "\\", "a ", "/"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("id", T.masked(F.col("text")).alias("m"), T.without_comments(F.col("text")).alias("w")).collect():
        assert r.m == python_mask(texts[r.id] or ""), texts[r.id]
    bare = df.select(T.without_comments(F.lit('u "http://x" /* c */ "a//b" // d\ny')).alias("w")).first().w
    assert bare == 'u "http://x"  "a//b" \ny'
    got = defaultdict(Counter)
    for r in structure.brace_ranges(df, "id").collect():
        got[r.id][r.start, r.end] += 1
    assert got == {k: c for k, t in enumerate(texts) if (c := python_braces(t or ""))}


def test_brace_query_equals_brute_force(spark):
    got = defaultdict(Counter)
    for r in evidence.q133(spark, FOLDER).collect():
        got[r.page_id][r.start, r.end] += 1
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert got == {p.page_id: c for p in pages if (c := python_braces(p.html or ""))}


# -- manuals ------------------------------------------------------------

MANUAL = """# Models

General conditions apply only when stated.

## 1.1 alpha

The pressure is given by

$$
p = \\rho e
$$
(1.1)

where $e$ is internal energy.

> **NOTE:** alpha works only for fluids.

| Variable | Description |
|---|---|
| $e$ | Energy |

```cpp
# This is a code comment, not a heading
value alpha;
```

## 1.2 beta

See 1.1 for alpha.

See Sections 1.1 and 2. Eq. (1.1). Equations 2012.
`Sec. 99` and $\\text{Section 98}$ are literal examples.

```text
See Sec. 97.
```

$$
\\text{Section 96}
$$
"""


def test_manual_units_and_links(spark):
    docs = spark.createDataFrame([("01_models.md", MANUAL), ("02_next.md", "# Next\n\nSecond chapter, see 9.9.\n"), ("e", None)], "id string, text string")
    units = [r for r in manual.manual_units(docs, "id").collect()]
    bound = next(r for r in units if r.number)
    assert (bound.kinds, bound.number, bound.start, bound.end) == (["formula", "text", "text"], "1.1", 9, 14)
    assert bound.text == "\n".join(MANUAL.split("\n")[8:14]) and bound.text.endswith("internal energy.")
    assert Counter(k for r in units for k in r.kinds)["formula"] == 2 and {"table", "code", "quote"} <= {k for r in units for k in r.kinds}
    heads = {(r.id, r.number, r.title) for r in manual.section_numbers(docs, "id").collect()}
    assert heads == {("01_models.md", "1", "Models"), ("01_models.md", "1.1", "1.1 alpha"), ("01_models.md", "1.2", "1.2 beta"), ("02_next.md", "2", "Next")}
    links = {(r.relation, r.number, r.to_id, r.to_line) for r in manual.manual_links(docs, "id").collect()}
    assert links == {("REFERS_TO_SECTION", "1.1", "01_models.md", 5), ("REFERS_TO_SECTION", "2", "02_next.md", 1), ("REFERS_TO_FORMULA", "1.1", "01_models.md", 9), ("REFERS_TO_SECTION", "9.9", None, None)}
    assert manual.unclosed(docs, "id").count() == 0
    broken = spark.createDataFrame([("f", "# X\n\n$$\nx=1\n"), ("c", "# X\n\n```cpp\nx=1\n"), ("g", "```\n```\n$$\n$$\n")], "id string, text string")
    assert {(r.id, r.what) for r in manual.unclosed(broken, "id").collect()} == {("f", "formula"), ("c", "code")}


def python_units(text):
    """Blocks of a text whose fences are all closed, by a walk over its lines."""
    blocks, kind, code, math, section = [], None, False, False, 0
    for n, t in enumerate(text.split("\n"), 1):
        bare, opens = t.strip(), False
        if code or bare.startswith("```"):
            new, code = "code", (not code if bare.startswith("```") else code)
        elif math or bare == "$$":
            new, opens = "formula", bare == "$$" and not math
            math = not math if bare == "$$" else math
        elif bare.startswith("$$") and bare.endswith("$$") and len(bare) > 4:
            new, opens = "formula", True
        elif not bare:
            new = None
        elif m := re.match(r"#{1,6}\s+", t):
            new, section = "heading", section + 1
        else:
            new = "table" if bare.startswith("|") else "quote" if bare.startswith(">") else "text"
        if new and (new != kind or new == "heading" or opens):
            blocks.append([section, new, n, n, [t]])
        elif new:
            blocks[-1][3] = n
            blocks[-1][4].append(t)
        kind = new
    out, before = [], []
    for section, kind, start, end, body in blocks:
        if kind == "heading":
            before = []
            continue
        number = re.match(r"\s*\(([A-Z]?\d+(?:\.\d+)*[a-z]?)\)\s*$", body[0]) if kind == "text" and len(body) == 1 else None
        where = kind == "text" and re.match(r"\s*(?:where\b|其中)", body[0], re.I)
        last, second = (before[-1] if before else ""), (before[-2] if len(before) > 1 else "")
        if number and last == "formula" or where and (last == "formula" or last == "number" and second == "formula"):
            out[-1][3] = end
            out[-1][4].append(kind)
            if number:
                out[-1][5] = number[1]
        else:
            out.append([section, None, start, end, [kind], None])
        before.append("number" if number else kind)
    return sorted((s, a, b, tuple(k), x) for s, _, a, b, k, x in out)


def test_manual_query_equals_a_walk_over_lines(spark):
    texts = {r.doc_id: r.text for r in evidence.manual_texts(spark, FOLDER).collect()}
    got = defaultdict(list)
    for r in evidence.q136(spark, FOLDER).collect():
        got[r.doc_id].append((r.section, r.start, r.end, tuple(r.kinds.split(",")), r.number))
    fine = {k: t for k, t in texts.items() if "~~~" not in t}
    assert len(fine) > 100
    for k, t in fine.items():
        assert sorted(got[k]) == python_units(t), k


ENTRIES = "case string, path string, key string, value string, status string"
DEFINITIONS = [("15.1", "alphaMeter", "alternateMeter", "Only scalar fields are supported; the field must already exist."), ("15.2", "betaMeter", None, "A different role."), ("15.3", "twice", None, ""), ("15.4", "twice", None, "")]
PARAMETERS = [("15.1", "fields", "Fields to inspect"), ("15.1", "reference", "Reference value (default 7)"), ("15.2", "fields", "Fields to write")]


def related(spark, rows):
    entries = spark.createDataFrame(rows, ENTRIES)
    definitions = spark.createDataFrame(DEFINITIONS, "definition string, name string, alias string, conditions string")
    parameters = spark.createDataFrame(PARAMETERS, "definition string, parameter string, description string")
    a, b = manual.cross_source(entries, definitions, parameters, "case")
    return a.collect(), {(r["case"], r.instance, r.reason) for r in b.collect()}


def test_relations_of_each_instance(spark):
    one = lambda c: [(c, "functions/a/type", "type", "alphaMeter", "ok"), (c, "functions/a/fields", "fields", "(p)", "ok"), (c, "functions/a/reference", "reference", "12", "ok"), (c, "functions/b/type", "type", "betaMeter", "ok"), (c, "functions/b/fields", "fields", "(rho)", "ok")]
    found, others = related(spark, one("A") + one("B"))
    assert len(found) == 10 and not others and {r["case"] for r in found} == {"A", "B"}
    param = next(r for r in found if r.parameter == "reference")
    assert "default 7" in param.description and "must already exist" in param.conditions


@pytest.mark.parametrize("rows,reason", [
    ([("f/a/type", "type", "alternateMeter", "ok")], "no_exact_primary_manual_definition"),
    ([("f/a/type", "type", "twice", "ok")], "several_definitions_of_one_name"),
    ([("f/a/type", "type", "alphaMeter", "ok"), ("f/a/type@2", "type", "betaMeter", "ok")], "unresolved_selector_or_ancestor"),
    ([("f/a/type", "type", "$x", "unresolved")], "unresolved_selector_or_ancestor"),
    ([("", "#include", "x", "ok"), ("f/a/type", "type", "alphaMeter", "ok")], "ancestor_scope_contains_unevaluated_directive_or_statement"),
    ([("f/a", "#if", "$x", "ok"), ("f/a/type", "type", "alphaMeter", "ok")], "ancestor_scope_contains_unevaluated_directive_or_statement"),
])
def test_candidates_have_reasons(spark, rows, reason):
    found, others = related(spark, [("A", *r) for r in rows])
    assert not found and others == {("A", "f/a", reason)}


def test_nested_entries_and_directives_elsewhere(spark):
    found, others = related(spark, [("A", "f/a/type", "type", "alphaMeter", "ok"), ("A", "f/a/nested/reference", "reference", "8", "ok"), ("A", "f/b", "#if", "x", "ok")])
    assert [r.relation for r in found] == ["SELECTOR_DOCUMENTED_BY"] and not others


# -- drafts -------------------------------------------------------------


def draft(spark, values, bindings=1, removals=(), existing=(), complete=True, b=("required", "scalar")):
    one = ("r", "anotherModel", "constant/properties", "solid/type", "constant/coefficients", "solid/settings", complete)
    frame = spark.createDataFrame
    said, edits = drafts.edit_drafts(
        frame([one] * bindings, "r string, model string, selector_path string, selector_entry string, path string, scope string, complete boolean"),
        frame([("anotherModel", "A", "required", "scalar"), ("anotherModel", "B", *b)], "model string, input string, requirement string, kind string"),
        frame([("r", k, v) for k, v in values.items()], "r string, input string, value string"),
        frame([("constant/coefficients", f"solid/settings/{e}") for e in existing], "path string, entry string"),
        frame([("r", k) for k in removals], "r string, input string"),
        "r",
    )
    return said.first().status, [(e.path, e.entry, e.value) for e in edits.orderBy("place").collect()]


def test_drafts_follow_bindings_and_never_guess(spark):
    first = ("constant/properties", "solid/type", "anotherModel")
    a, b = (("constant/coefficients", f"solid/settings/{k}", v) for k, v in (("A", "2e-6"), ("B", "42")))
    assert draft(spark, {"A": "2e-6", "B": "42"}) == ("draft_requires_review", [first, a, b])
    assert draft(spark, {"A": "1"}) == ("missing_inputs", [])
    assert draft(spark, {"A": "NaN", "B": "1"})[0] == "invalid_scalar_input"
    assert draft(spark, {"A": "1", "B": "2"}, bindings=2)[0] == draft(spark, {"A": "1"}, bindings=0)[0] == "ambiguous_or_missing_model_binding"
    assert draft(spark, {"A": "2e-6"}, b=("optional", "scalar")) == ("draft_requires_review", [first, a])
    assert draft(spark, {"A": "2", "B": "3"}, b=("conditional", "scalar"))[0] == "unresolved_input_condition"
    assert draft(spark, {"A": "2", "B": "3"}, complete=False)[0] == "incomplete_source_schema"
    assert draft(spark, {"A": "2", "B": "3"}, b=("required", None))[0] == "unsupported_input_type"
    gone = draft(spark, {"A": "2e-6", "B": "42"}, removals=["old"], existing=["old", "A"])
    assert gone[1][-1] == ("constant/coefficients", "solid/settings/old", None)
    assert draft(spark, {"A": "2", "B": "4"}, removals=["absent"], existing=["old"])[0] == "unbound_removal"
    assert draft(spark, {"A": "2", "B": "4"}, removals=["A"], existing=["A"])[0] == "conflicting_model_edits"


def test_chains_and_missing_inputs(spark):
    frame = spark.createDataFrame
    needs = frame([("r1", "a"), ("r1", "b"), ("r2", "c"), ("r3", "x"), ("r3", "d"), ("r4", "e"), ("r1", "a")], "rule string, need string")
    gives = frame([("r1", "c"), ("r2", "d"), ("r2", "a"), ("r3", "e"), ("r4", "x")], "rule string, fact string")
    facts = frame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "q int, fact string")
    known = drafts.forward_chain(facts, needs, gives, "q")
    assert {(r.q, r.fact, r["round"]) for r in known.collect()} == {(1, "a", 0), (1, "b", 0), (1, "c", 1), (1, "d", 2), (2, "a", 0)}
    goals = frame([(1, "d"), (1, "e"), (2, "d"), (2, "zzz")], "q int, fact string")
    got = {(r.q, r.goal, r.missing) for r in drafts.missing_inputs(goals, known, needs, gives, "q").collect()}
    # e and x need each other, so no input alone would do
    assert got == {(2, "d", "b"), (2, "zzz", "zzz")}


# -- details ------------------------------------------------------------


def test_details_stay_in_their_buckets(spark, tmp_path):
    rows = spark.range(500).select(detail.result_id("x", F.col("id")).alias("result_id"), F.col("id").alias("v"))
    detail.write_details(rows, "details_test", f"file://{tmp_path}/d", 8)
    try:
        ids = [r.result_id for r in rows.limit(3).collect()]
        chosen = spark.createDataFrame([(k, i) for k, i in enumerate([*ids, "x:unknown", None])], "k int, result_id string")
        found = detail.look_up(spark, "details_test", chosen)
        assert sorted((r.k, r.found, r.v) for r in found.collect())[:3] == [(k, True, r.v) for k, r in enumerate(rows.limit(3).collect())]
        assert [r.found for r in found.orderBy("k").collect()[3:]] == [False, False]
        plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        few = detail.one_detail(spark, "details_test", ids[:1])
        assert few.count() == 1 and "out of 8" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("drop table details_test")
