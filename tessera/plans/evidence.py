"""Queries of evidence choice, details, work, containers, drafts, manuals and identity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import choice, detail, drafts, identity, manual, ranking, structure
from tessera.operators.cases import atomic_groups
from tessera.plans.cases import _LINES, _lines
from tessera.plans.common import CASE_FILES_SQL, CASES_SQL, HITS_SQL, PASSAGES_SQL, case_dirs, table, texts
from tessera.session import shared_dir
from tessera.sources.corpus import numbered_lines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_ORDER = "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
_PLACED = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS place FROM lineitem)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` with the place of each line in its order; line numbers repeat."""
    return table(spark, d, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


_DOC_LINES = "dl AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE length(text) > 0)"


@query("q127_bundle", f"""WITH RECURSIVE {_DOC_LINES},
asked AS (SELECT l_orderkey AS o, place, l_orderkey // 16 AS doc_id, 1 + l_suppkey % 5 AS s, 2 + l_suppkey % 5 + CAST(l_quantity AS BIGINT) % 7 AS e FROM {_PLACED}),
r AS (SELECT o, place, doc_id, l, list_filter(range(s, e + 1), lambda x: x <= len(l)) AS want, row_number() OVER (PARTITION BY o ORDER BY place) AS k FROM asked JOIN dl USING (doc_id)),
f AS (SELECT o, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS have, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS got FROM r WHERE k = 1
 UNION ALL SELECT o, k, CASE WHEN used + cost <= 900 THEN used + cost ELSE used END, CASE WHEN used + cost <= 900 THEN list_concat(have, fresh) ELSE have END, place, CASE WHEN used + cost <= 900 THEN fresh ELSE CAST([] AS BIGINT[]) END
 FROM (SELECT *, CAST(coalesce(list_sum(list_transform(fresh, lambda x: length(l[x]) + 1)), 0) AS BIGINT) AS cost FROM (
   SELECT r.o, r.k, r.place, r.l, f.used, f.have, list_filter(r.want, lambda x: NOT list_contains(f.have, x)) AS fresh FROM f JOIN r ON f.o = r.o AND r.k = f.k + 1))),
each AS (SELECT o, place, unnest(got) AS line FROM f),
islands AS (SELECT *, line - row_number() OVER (PARTITION BY o, place ORDER BY line) AS i FROM each)
SELECT o AS l_orderkey, CAST(place AS BIGINT) AS place, doc_id, CAST(min(line) AS BIGINT) AS "start", CAST(max(line) AS BIGINT) AS "end", sha256(string_agg(l[line], chr(10) ORDER BY line)) AS text_sha256
FROM islands JOIN dl ON doc_id = o // 16 GROUP BY o, place, doc_id, i""")
def q127(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of lines of one document for each order, cut to what was not delivered yet."""
    start = 1 + F.col("l_suppkey") % 5
    end = start + 1 + F.col("l_quantity").cast("long") % 7
    ranked = _placed(spark, d).select("l_orderkey", "place", F.floor(F.col("l_orderkey") / 16).alias("path"), start.alias("start"), end.alias("end"))
    lines = numbered_lines(texts(spark, d)).withColumnRenamed("doc_id", "path")
    found = choice.bundle(ranked, lines, "l_orderkey", 900)
    whole = [F.col(c).cast("long").alias(c) for c in ("place", "start", "end")]
    return found.select("l_orderkey", whole[0], F.col("path").alias("doc_id"), *whole[1:], F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def context_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of documents as fragments, runs of four and of eight as containers, and each eight documents' longest lines as hits."""
    lines = numbered_lines(texts(spark, d))
    unit = F.concat_ws(":", "doc_id", "line")
    units = lines.select(unit.alias("unit"), F.col("doc_id").alias("path"), F.col("line").alias("at"), F.length("text").cast("long").alias("chars"), (F.length("text") % 17 == 3).alias("barrier"))
    last = units.groupBy("path").agg(F.max("at").alias("_n"))
    runs = last.select("path", "_n", F.explode(F.array(F.lit(4), F.lit(8))).alias("_w")).select("path", "_n", "_w", F.explode(F.sequence(F.lit(1), "_n", "_w")).alias("first"))
    runs = runs.select(F.concat_ws(":", "path", "_w", "first").alias("container"), "path", "first", F.least("_n", F.col("first") + F.col("_w") - 1).alias("last"))
    best = units.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("chars"), "at"))).where("_r <= 3")
    seeds = best.select(F.floor(F.col("path") / 8).alias("request"), "unit", "path", "chars", "at")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("chars"), "path", "at"))
    return seeds.select("request", rank.alias("rank"), "unit"), units, runs


@query("q128_context")
def q128(spark: SparkSession, d: str) -> DataFrame:
    """What each ranked line brings along; each step depends on the budget left, so a brute-force test stands in for SQL."""
    return choice.grow_context(*context_inputs(spark, d), "request", 1_200)


@query("q129_fresh_groups", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY flag <> 'R', place) AS k FROM {_LINES} WHERE NOT (size % 3 = 1)),
f AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS chars FROM r WHERE k = 1
 UNION ALL SELECT r.l_orderkey, r.k, CASE WHEN used + size <= 60 THEN used + size ELSE used END, CASE WHEN used + size <= 60 THEN r.place END, CASE WHEN used + size <= 60 THEN size END FROM f JOIN r ON f.l_orderkey = r.l_orderkey AND r.k = f.k + 1)
SELECT l_orderkey, place, chars FROM f WHERE place IS NOT NULL""")
def q129(spark: SparkSession, d: str) -> DataFrame:
    """As q115, without the groups that a request has seen."""
    lines = _lines(spark, d)
    return atomic_groups(lines, "l_orderkey", "place", "place", "size", 60, F.col("flag") == "R", lines.where("size % 3 = 1"))


_ASKED = "CASE c_custkey % 4 WHEN 0 THEN concat('waves in ', n_name, '/', c_name, ' now') WHEN 1 THEN concat('the case ', c_name) WHEN 2 THEN concat('order ', CAST(c_custkey AS STRING), ' of it') ELSE 'nothing named' END"


@query("q130_scopes", f"""WITH {CASE_FILES_SQL}, {CASES_SQL},
asked AS (SELECT c_custkey, {_ASKED.replace("AS STRING", "AS VARCHAR")} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
words AS (SELECT DISTINCT c_custkey, unnest(regexp_extract_all(text, '[A-Za-z0-9_.#/-]+')) AS word FROM asked),
parts AS (SELECT "case", string_split("case", '/') AS p FROM cases),
ends AS (SELECT "case", k, array_to_string(p[len(p) - k + 1:], '/') AS word FROM (SELECT "case", p, unnest(range(1, len(p) + 1)) AS k FROM parts)),
met AS (SELECT c_custkey, "case", max(k > 1) AS literal FROM words JOIN ends USING (word) GROUP BY ALL),
anys AS (SELECT c_custkey, max(literal) AS a, count(*) AS n FROM met GROUP BY ALL)
SELECT c_custkey, CASE WHEN a THEN 'literal_path' WHEN n = 1 THEN 'unique_basename' ELSE 'ambiguous_basename' END AS mode, "case" FROM met JOIN anys USING (c_custkey) WHERE literal OR NOT a
UNION ALL SELECT c_custkey, 'all', NULL FROM asked WHERE c_custkey NOT IN (SELECT c_custkey FROM met)""")
def q130(spark: SparkSession, d: str) -> DataFrame:
    """Cases that customers' requests name, by path or by last name."""
    named = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return choice.case_scopes(named.select("c_custkey", F.expr(_ASKED).alias("text")), case_dirs(spark, d), "c_custkey")


@query("q131_details", """WITH s AS (SELECT 'document:' || sha1('{"kind":"document","k0":' || doc_id || ',"k1":' || to_json(source) || '}')[:16] AS result_id, doc_id, length(text) AS chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
a AS (SELECT labels.doc_id, CASE WHEN labels.doc_id % 3 = 0 THEN 'document:unknown' ELSE result_id END AS result_id FROM labels JOIN s USING (doc_id))
SELECT a.doc_id, a.result_id, s.result_id IS NOT NULL AS found, CAST(s.chars AS BIGINT) AS chars, s.text_sha256 FROM a LEFT JOIN s USING (result_id)""")
def q131(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of labelled documents, some of them unknown, and the details behind them."""
    docs = table(spark, d, "documents")
    rid = detail.result_id("document", F.col("doc_id"), F.col("source"))
    name = f"details_{uuid.uuid4().hex}"
    stored = docs.select(rid.alias("result_id"), F.length("text").cast("long").alias("chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    detail.write_details(stored, name, f"{shared_dir(spark)}/{name}", 16)
    candidates = docs.select("doc_id", rid.alias("_id")).join(table(spark, d, "labels").select("doc_id"), "doc_id")
    chosen = candidates.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "document:unknown").otherwise(F.col("_id")).alias("result_id"))
    return detail.look_up(spark, name, chosen).select("doc_id", "result_id", "found", "chars", "text_sha256")


@query("q132_work", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL},
v AS (SELECT count(*) AS n FROM tf JOIN asked USING (term)), p AS (SELECT count(*) AS n FROM embeddings), q AS (SELECT count(*) AS n FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))
SELECT v.n AS bm25_posting_visits, p.n * q.n AS dense_dot_products, (SELECT CAST(sum(length(text)) AS BIGINT) FROM passages) AS characters_scanned FROM v, p, q""")
def q132(spark: SparkSession, d: str) -> DataFrame:
    """What the lexical and the dense ranking of all benchmark items have visited, as their tasks counted it."""
    lexical, products, read = Observation(), Observation(), Observation()
    units = ranking.passages(texts(spark, d)).observe(read, F.sum(F.length("text")).alias("characters_scanned"))
    items, vectors = table(spark, d, "benchmark"), table(spark, d, "embeddings")
    asked = items.select("item_id").distinct().join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    best = ranking.bm25(units, items, "passage_id", "item_id", work=lexical)
    near = ranking.dense(vectors, asked, "vec_id", "item_id", work=products)
    for found in (best, near):
        found.write.format("noop").mode("overwrite").save()
    work = lexical.get | products.get | read.get
    return spark.createDataFrame([(work["bm25_posting_visits"], work["dense_dot_products"], work["characters_scanned"])], "bm25_posting_visits long, dense_dot_products long, characters_scanned long")


@query("q133_brace_ranges")
def q133(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of braces in pages; a brute-force test stands in for SQL."""
    return structure.brace_ranges(table(spark, d, "pages"), "page_id", "html")


_RULES_SQL = "SELECT p_partkey AS k, p_partkey // 2 AS a, p_partkey // 3 AS b FROM part WHERE p_partkey >= 6 AND p_partkey % 5 <> 0"


@query("q134_forward_chain", f"""WITH RECURSIVE base AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS fact FROM lineitem), rules AS ({_RULES_SQL}),
st AS (SELECT s, fact, 0 AS round, 0 AS r FROM base
 UNION ALL SELECT * FROM (SELECT s, fact, min(round) AS round, r + 1 AS r FROM (
   SELECT s, fact, round, r FROM st UNION ALL SELECT x.s, k, x.r + 1, x.r FROM st x JOIN rules ON x.fact = a JOIN st y ON y.s = x.s AND y.fact = b) GROUP BY s, fact, r) WHERE r <= 20)
SELECT s AS l_suppkey, fact, round FROM st WHERE r = 20""")
def q134(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a supplier can make of those it has: a part needs two smaller ones."""
    facts = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("fact"))
    needs, gives = chain_rules(spark, d)
    return drafts.forward_chain(facts, needs, gives, "l_suppkey")


def chain_rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    made = table(spark, d, "part").where((k >= 6) & (k % 5 != 0))
    needs = made.select(k.alias("rule"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("need"))
    return needs, made.select(k.alias("rule"), k.alias("fact"))


_DRAFT = {
    "bindings": "SELECT s_suppkey, 'm' || s_nationkey AS model, 'constant/p' AS selector_path, 'gas/type' AS selector_entry, 'constant/c' || s_suppkey AS path, 'gas/settings' AS scope, s_nationkey % 12 <> 11 AS complete FROM supplier WHERE s_suppkey % 11 <> 0 UNION ALL SELECT s_suppkey, 'other', 'constant/p', 'gas/type', 'constant/c' || s_suppkey, 'gas/settings', true FROM supplier WHERE s_suppkey % 7 = 0",
    "inputs": "SELECT 'm' || n_nationkey AS model, 'A' AS input, 'required' AS requirement, CASE WHEN n_nationkey % 9 = 8 THEN 'list' ELSE 'scalar' END AS kind FROM nation UNION ALL SELECT 'm' || n_nationkey, 'B', CASE n_nationkey % 5 WHEN 4 THEN 'conditional' WHEN 3 THEN 'required' ELSE 'optional' END, 'scalar' FROM nation",
    "given": "SELECT s_suppkey, 'A' AS input, CASE WHEN s_suppkey % 13 = 0 THEN 'NaN' ELSE s_suppkey || 'e-3' END AS value FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'B', '-.5' FROM supplier WHERE s_suppkey % 2 = 0",
    "existing": "SELECT 'constant/c' || s_suppkey AS path, 'gas/settings/' || x AS entry FROM (SELECT s_suppkey, unnest(['old', 'A']) AS x FROM supplier) WHERE s_suppkey % 4 <> 1",
    "removals": "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'A' ELSE 'old' END AS input FROM supplier WHERE s_suppkey % 3 = 0",
}


@query("q135_edit_drafts", f"""WITH {', '.join(f'{k} AS ({v})' for k, v in _DRAFT.items())},
one AS (SELECT s_suppkey, count(*) AS n FROM bindings GROUP BY ALL), bound AS (SELECT b.* FROM bindings b JOIN one USING (s_suppkey) WHERE n = 1),
reads AS (SELECT b.*, i.input, requirement, kind, value FROM bound b JOIN inputs i USING (model) LEFT JOIN given g ON g.s_suppkey = b.s_suppkey AND g.input = i.input),
gone AS (SELECT b.s_suppkey, r.input, b.path, scope || '/' || r.input AS entry, x.entry IS NOT NULL AS there, EXISTS (SELECT 1 FROM reads d WHERE d.s_suppkey = b.s_suppkey AND d.input = r.input AND value IS NOT NULL) AS is_set FROM removals r JOIN bound b USING (s_suppkey) LEFT JOIN existing x ON x.path = b.path AND x.entry = scope || '/' || r.input),
st AS (SELECT a.s_suppkey, CASE WHEN coalesce(n, 0) <> 1 THEN 'ambiguous_or_missing_model_binding' WHEN NOT (SELECT complete FROM bound b WHERE b.s_suppkey = a.s_suppkey) THEN 'incomplete_source_schema'
  WHEN EXISTS (SELECT 1 FROM reads d WHERE d.s_suppkey = a.s_suppkey AND requirement = 'conditional') THEN 'unresolved_input_condition'
  WHEN EXISTS (SELECT 1 FROM reads d WHERE d.s_suppkey = a.s_suppkey AND kind <> 'scalar' AND (requirement = 'required' OR value IS NOT NULL)) THEN 'unsupported_input_type'
  WHEN EXISTS (SELECT 1 FROM reads d WHERE d.s_suppkey = a.s_suppkey AND requirement = 'required' AND value IS NULL) THEN 'missing_inputs'
  WHEN EXISTS (SELECT 1 FROM reads d WHERE d.s_suppkey = a.s_suppkey AND isfinite(TRY_CAST(value AS DOUBLE)) = false) THEN 'invalid_scalar_input'
  WHEN EXISTS (SELECT 1 FROM gone d WHERE d.s_suppkey = a.s_suppkey AND is_set) THEN 'conflicting_model_edits'
  WHEN EXISTS (SELECT 1 FROM gone d WHERE d.s_suppkey = a.s_suppkey AND NOT there) THEN 'unbound_removal' ELSE 'draft_requires_review' END AS status
  FROM (SELECT s_suppkey FROM bindings UNION SELECT s_suppkey FROM given UNION SELECT s_suppkey FROM removals) a LEFT JOIN one USING (s_suppkey)),
e AS (SELECT s_suppkey, 0 AS k, selector_path AS path, selector_entry AS entry, model AS value FROM bound UNION ALL SELECT s_suppkey, 1, path, scope || '/' || input, value FROM reads WHERE value IS NOT NULL UNION ALL SELECT s_suppkey, 2, path, entry, NULL FROM gone)
SELECT s_suppkey, status, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY k, entry) - 1 AS BIGINT) AS place, path, entry, value FROM st LEFT JOIN e USING (s_suppkey) WHERE status = 'draft_requires_review'
UNION ALL SELECT s_suppkey, status, NULL, NULL, NULL, NULL FROM st WHERE status <> 'draft_requires_review'""")
def q135(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of edits of suppliers' cases, or why there is none."""
    supplier, nation, s, n = table(spark, d, "supplier"), table(spark, d, "nation"), F.col("s_suppkey"), F.col("n_nationkey")
    own, lit = F.concat(F.lit("constant/c"), s.cast("string")), F.lit
    bind = lambda df, model, complete: df.select("s_suppkey", model.alias("model"), lit("constant/p").alias("selector_path"), lit("gas/type").alias("selector_entry"), own.alias("path"), lit("gas/settings").alias("scope"), complete.alias("complete"))
    bindings = bind(supplier.where(s % 11 != 0), F.concat(lit("m"), F.col("s_nationkey").cast("string")), F.col("s_nationkey") % 12 != 11).unionByName(bind(supplier.where(s % 7 == 0), lit("other"), lit(True)))
    read = lambda name, requirement, kind: nation.select(F.concat(lit("m"), n.cast("string")).alias("model"), lit(name).alias("input"), requirement.alias("requirement"), kind.alias("kind"))
    inputs = read("A", lit("required"), F.when(n % 9 == 8, "list").otherwise("scalar")).unionByName(read("B", F.when(n % 5 == 4, "conditional").when(n % 5 == 3, "required").otherwise("optional"), lit("scalar")))
    given = supplier.where(s % 5 != 0).select("s_suppkey", lit("A").alias("input"), F.when(s % 13 == 0, "NaN").otherwise(F.concat(s.cast("string"), lit("e-3"))).alias("value"))
    given = given.unionByName(supplier.where(s % 2 == 0).select("s_suppkey", lit("B").alias("input"), lit("-.5").alias("value")))
    existing = supplier.where(s % 4 != 1).select(own.alias("path"), F.explode(F.array(lit("gas/settings/old"), lit("gas/settings/A"))).alias("entry"))
    removals = supplier.where(s % 3 == 0).select("s_suppkey", F.when(s % 10 == 3, "A").otherwise("old").alias("input"))
    said, edits = drafts.edit_drafts(bindings, inputs, given, existing, removals, "s_suppkey")
    return said.join(edits, "s_suppkey", "left").select("s_suppkey", "status", F.col("place").cast("long").alias("place"), "path", "entry", "value")


@query("q136_manual_units")
def q136(spark: SparkSession, d: str) -> DataFrame:
    """Units of manuals made of documents: each text with a formula, its number and explanation between its lines; a brute-force test stands in for SQL."""
    return manual.manual_units(manual_texts(spark, d), "doc_id").select("doc_id", "section", "unit", "start", "end", F.array_join("kinds", ",").alias("kinds"), "number", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def manual_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    formula = F.concat(F.lit("\n$$\nx = y\n$$\n"), F.when(k % 3 > 0, F.concat(F.lit("("), (k % 9).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(")\n\n"))).otherwise(""), F.when(k % 2 == 0, "where x is meant.\n").otherwise("Otherwise.\n"))
    text = F.concat(F.lit("## "), (k % 9).cast("string"), F.lit(".1 First\n\nSee "), (k % 11).cast("string"), F.lit(".1 and `Sec. 99`, 2012.\n\n"), F.coalesce("text", F.lit("")), formula, F.lit("\n```\n# no heading\n\n```\n| a | b |\n> quoted\n"))
    return texts(spark, d).select("doc_id", text.alias("text"))


@query("q137_cross_source", f"""WITH defs AS (SELECT p_brand AS name, count(*) AS homonyms FROM (SELECT DISTINCT p_brand, CASE WHEN ends_with(p_brand, '3') THEN p_size % 2 ELSE 0 END FROM part) GROUP BY ALL),
made AS (SELECT l_orderkey AS o, place, p_brand, p_type, p_size, CAST(l_quantity AS BIGINT) AS q FROM {_PLACED} JOIN part ON l_partkey = p_partkey),
told AS (SELECT i.*, CASE WHEN q % 10 = 0 THEN p_type ELSE p_brand END AS value, q % 7 = 0 AS doubled, q % 9 = 0 AS unsound, max(CASE WHEN q % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o) AS directive FROM made i),
good AS (SELECT t.*, CASE WHEN doubled OR unsound THEN 'unresolved_selector_or_ancestor' WHEN directive = 1 THEN 'ancestor_scope_contains_unevaluated_directive_or_statement' WHEN homonyms IS NULL THEN 'no_exact_primary_manual_definition' WHEN homonyms > 1 THEN 'several_definitions_of_one_name' END AS reason FROM told t LEFT JOIN defs ON name = value)
SELECT o AS l_orderkey, 'functions/f' || place AS instance, CASE WHEN reason IS NULL THEN 'SELECTOR_DOCUMENTED_BY' END AS relation, NULL AS parameter, reason FROM good
UNION ALL SELECT o, 'functions/f' || place, 'PARAMETER_DOCUMENTED_BY', 'size', NULL FROM good WHERE reason IS NULL AND p_size > 10""")
def q137(spark: SparkSession, d: str) -> DataFrame:
    """Instances made of order lines, whose selectors name brands, some of which have two definitions."""
    part = table(spark, d, "part")
    lines = _placed(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey"))
    q, at = F.col("l_quantity").cast("long"), F.concat(F.lit("functions/f"), F.col("place").cast("string"))
    one = lambda path, key, value, status="ok": F.struct(F.concat_ws("/", at, F.lit(path)).alias("path"), F.lit(key).alias("key"), value.alias("value"), status.alias("status") if not isinstance(status, str) else F.lit(status).alias("status"))
    chosen = F.when(q % 10 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    again = F.when(q % 7 == 0, one("type@2", "type", F.col("p_brand")))
    own = F.when(F.col("p_size") > 10, one("size", "size", F.col("p_size").cast("string"))).otherwise(one("nested/size", "size", F.col("p_size").cast("string")))
    directive = F.when(q % 13 == 0, F.struct(F.lit("functions").alias("path"), F.lit("#include").alias("key"), F.lit("x").alias("value"), F.lit("ok").alias("status")))
    made = F.filter(F.array(one("type", "type", chosen, F.when(q % 9 == 0, "unresolved").otherwise("ok")), again, own, directive), lambda x: x.isNotNull())
    role = F.when(F.col("p_brand").endswith("3"), F.col("p_size") % 2).otherwise(0)
    definitions = part.select(F.concat_ws(" ", "p_brand", role.cast("string")).alias("definition"), F.col("p_brand").alias("name"), F.lit("other").alias("alias"), F.lit("as stated").alias("conditions")).distinct()
    parameters = definitions.select("definition", F.lit("size").alias("parameter"), F.lit("Size (default 7)").alias("description"))
    relations, others = manual.cross_source(lines.select("l_orderkey", F.inline(made)), definitions, parameters, "l_orderkey")
    none = F.lit(None).cast("string")
    return relations.select("l_orderkey", "instance", "relation", "parameter", none.alias("reason")).unionByName(others.select("l_orderkey", "instance", none.alias("relation"), none.alias("parameter"), "reason"))


_HEAD = "split_part(coalesce(text, ''), chr(10), 1)"
_FOLD = "strip_accents(replace(lower({0}), 'ß', 'ss'))"
_WORDS = "regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*')"


def _distinct_words(text: str) -> str:
    return f"unnest(list_distinct({_WORDS.format(_FOLD.format(text))}))"


@query("q138_identity", f"""WITH d AS (SELECT doc_id, text, lang AS c, {_HEAD} AS h, source AS f FROM documents),
asked AS (SELECT item_id, word, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT item_id, {_distinct_words("coalesce(text, '')")} AS word FROM benchmark) WHERE word NOT IN ('the', 'de', 'la', 'und')),
heads AS (SELECT doc_id, {_distinct_words('h')} AS word FROM d),
plain AS (SELECT item_id, doc_id, count(*) AS score FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[^ \n.,]+'))) AS word FROM benchmark) JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(h), '[^ \n.,]+'))) AS word FROM d) USING (word) GROUP BY ALL),
fold AS (SELECT item_id, doc_id, count(*) AS score FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^ \n.,]+'))) AS word FROM benchmark) JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_FOLD.format('h')}, '[^ \n.,]+'))) AS word FROM d) USING (word) GROUP BY ALL),
seeds AS (SELECT item_id, doc_id, max(score) AS score FROM (SELECT * FROM plain UNION ALL SELECT * FROM fold) GROUP BY ALL),
hits AS (SELECT item_id, doc_id, count(*) AS n_head FROM heads JOIN asked USING (word) GROUP BY ALL),
files AS (SELECT item_id, doc_id FROM d JOIN asked ON word = f), named AS (SELECT item_id, doc_id FROM d JOIN asked ON word = lower(c)),
ids AS (SELECT item_id, doc_id FROM seeds UNION SELECT item_id, doc_id FROM hits UNION SELECT item_id, doc_id FROM files UNION SELECT item_id, doc_id FROM named),
exact AS (SELECT item_id, doc_id, count(*) AS n_exact FROM (SELECT doc_id, {_distinct_words("coalesce(text, '')")} AS word FROM d) JOIN asked USING (word) GROUP BY ALL),
keys AS (SELECT item_id, doc_id, count(*) AS n_keys FROM (SELECT DISTINCT doc_id, unnest([lower(c), f, 'text']) AS word FROM d) JOIN asked USING (word) GROUP BY ALL),
sizes AS (SELECT item_id, min(n) AS n FROM asked GROUP BY ALL)
SELECT item_id, doc_id, round(0.45 * coalesce(score, 0) + 24.0 * coalesce(n_exact, 0) / greatest(1, coalesce(n, 0)) + CASE WHEN files.doc_id IS NOT NULL THEN 24 ELSE 0 END + CASE WHEN named.doc_id IS NOT NULL THEN 12 ELSE 0 END
  + CASE WHEN coalesce(n_keys, 0) >= 2 THEN 12.0 * n_keys / greatest(1, n) ELSE 0 END + 8 * coalesce(n_head, 0), 6) AS score
FROM ids LEFT JOIN seeds USING (item_id, doc_id) LEFT JOIN hits USING (item_id, doc_id) LEFT JOIN files USING (item_id, doc_id) LEFT JOIN named USING (item_id, doc_id) LEFT JOIN exact USING (item_id, doc_id) LEFT JOIN keys USING (item_id, doc_id) LEFT JOIN sizes USING (item_id)""")
def q138(spark: SparkSession, d: str) -> DataFrame:
    """Documents for benchmark items: two passes over first lines, with and without accents, and what the texts have of the items' words."""
    docs = texts(spark, d).withColumn("head", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    items = table(spark, d, "benchmark").select("item_id", "text")
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[^ \n.,]+"), F.lit(0)))).alias("word")
    shared = lambda f: docs.select("doc_id", words(f(F.col("head")))).join(items.select("item_id", words(f(F.coalesce("text", F.lit(""))))), "word").groupBy("item_id", F.col("doc_id").alias("unit")).agg(F.count("*").alias("score"))
    seeds = identity.higher_of([shared(F.lower), shared(T.identity_fold)], ["item_id", "unit"])
    units = docs.select(F.col("doc_id").alias("unit"), F.concat_ws("/", "doc_id", "source").alias("path"), F.col("lang").alias("case"), F.col("head").alias("heading"), F.lit(False).alias("manual"), "text")
    declared = docs.select(F.concat_ws("/", "doc_id", "source").alias("path"), F.explode(F.array("lang", "source", F.lit("text"))).alias("key")).where("key is not null")
    return identity.identity_scores(seeds, items, units, declared, "item_id", ("the", "de", "la", "und")).select("item_id", F.col("unit").alias("doc_id"), "score")


@query("q139_variables", """WITH e AS (SELECT p_brand AS c, p_partkey AS variable, 'pSize' || p_size AS k, 'gas/' || p_type AS p FROM part),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_]', ' ', 'g')), '[^a-z0-9./]', ' ', 'g'), ' +', ' ', 'g')) AS nk,
  trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_]', ' ', 'g')), '[^a-z0-9./]', ' ', 'g'), ' +', ' ', 'g')) AS np FROM e),
a AS (SELECT s_suppkey, 'Brand#' || (1 + s_suppkey % 25) AS c, 'p size' || (1 + s_suppkey % 50) AS w FROM supplier)
SELECT s_suppkey, variable, k AS key, p AS path FROM a JOIN n ON a.c = n.c AND (w = nk OR w = np)""")
def q139(spark: SparkSession, d: str) -> DataFrame:
    """Variables of brands' parts that suppliers ask for by a name that differs in case and hyphens."""
    part = table(spark, d, "part")
    entries = part.select(F.col("p_brand").alias("case"), F.col("p_partkey").alias("variable"), F.concat(F.lit("pSize"), F.col("p_size").cast("string")).alias("key"), F.concat(F.lit("gas/"), "p_type").alias("path"))
    asked = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("case"), F.concat(F.lit("p-Size"), (1 + F.col("s_suppkey") % 50).cast("string")).alias("name"))
    return detail.find_variables(asked, entries).select("s_suppkey", "variable", "key", "path")


@query("q140_grown_lines")
def q140(spark: SparkSession, d: str) -> DataFrame:
    """A line of each document widened by whole lines on both sides; a brute-force test stands in for SQL."""
    docs = texts(spark, d)
    lines = numbered_lines(docs).withColumnRenamed("doc_id", "path")
    last = lines.groupBy("path").agg(F.max("line").alias("n"))
    start = 1 + F.col("path") % F.col("n")
    anchors = last.select("path", start.alias("start"), F.least("n", start + F.col("path") % 3).alias("end"))
    return choice.grow_lines(anchors.withColumn("doc_id", F.col("path")), lines, ["doc_id"], 600).select("doc_id", "start", "end", "left", "right")
