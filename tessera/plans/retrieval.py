"""Queries over the corpus: scans, listings, search, ranking, fusion and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ranges, ranking, selection
from tessera.plans.common import CASE_FILES_SQL, CASES_SQL, HITS_SQL, PASSAGES_SQL, case_dirs, case_files, item_hits, table, texts, tokens_sql
from tessera.session import cut
from tessera.sources import corpus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_LINES = "string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))"


@query("q01_inventory", f"SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(CASE WHEN length(text) > 0 THEN len({_LINES}) ELSE 0 END AS BIGINT) AS n_lines FROM documents")
def q01(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.when(F.length("text") > 0, F.size(T.lines(F.col("text")))).otherwise(0)
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), n.cast("long").alias("n_lines"))


@query("q02_range_mapping", f"""
WITH r AS (SELECT doc_id + doc_id % 3 * 1000000 * (doc_id % 5 // 4) AS doc_id, doc_id % 7 + 1 AS "start", doc_id % 7 + 1 + doc_id % 5 AS "end", CASE WHEN doc_id % 11 = 0 THEN 'png' ELSE 'txt' END AS suffix FROM documents),
l AS (SELECT doc_id, {_LINES} AS l FROM documents)
SELECT doc_id, "start", "end", suffix, CASE WHEN ok THEN 'mapped' ELSE 'unmappable' END AS mapping_status, CASE WHEN ok THEN sha256(array_to_string(l["start":"end"], chr(10))) END AS excerpt_sha256
FROM (SELECT r.*, l, coalesce(suffix <> 'png' AND "end" <= len(l), false) AS ok FROM r LEFT JOIN l ON r.doc_id = l.doc_id)""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    i, docs = F.col("doc_id"), texts(spark, d)
    moved = i + i % 3 * 1_000_000 * F.floor((i % 5) / 4)
    asked = docs.select(moved.alias("doc_id"), (i % 7 + 1).cast("int").alias("start"), (i % 7 + 1 + i % 5).cast("int").alias("end"), F.when(i % 11 == 0, "png").otherwise("txt").alias("suffix"))
    found = corpus.map_ranges(asked, docs.select("doc_id", "text"))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "suffix", "mapping_status", F.sha2(F.col("excerpt").cast("binary"), 256).alias("excerpt_sha256"))


@query("q03_cases", f"WITH {CASE_FILES_SQL}, {CASES_SQL}, r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS c, arg_min(path, CASE WHEN ends_with(path, '.md') THEN 1 ELSE 2 END) AS readme FROM files WHERE regexp_extract(path, '[^/]*$') IN ('README', 'README.md') GROUP BY 1) SELECT \"case\", readme FROM cases LEFT JOIN r ON c = \"case\"")
def q03(spark: SparkSession, d: str) -> DataFrame:
    files = case_files(spark, d).select("path")
    return corpus.complete_cases(files).join(corpus.first_readme(files), "case", "left")


@query("q04_time_values", """
WITH n AS (SELECT DISTINCT user_id, CAST(CAST(value AS DECIMAL(12, 1)) AS VARCHAR) AS name FROM events WHERE value >= 0),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY name) AS r FROM n),
p AS (SELECT user_id, name, CAST(name AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY CAST(name AS DOUBLE), name) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM c WHERE r <= 240)
SELECT user_id, name, value, place FROM p WHERE place <= 8 OR place > n - 8""")
def q04(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "events").where("value >= 0").select("user_id", F.col("value").cast("decimal(12,1)").cast("string").alias("name"))
    found = corpus.time_values(names, "user_id")
    n = found.groupBy("user_id").agg(F.count("*").alias("n"))
    return found.join(n, "user_id").where("place <= 8 or place > n - 8").select("user_id", "name", "value", F.col("place").cast("long").alias("place"))


@query("q05_case_logs", f"WITH {CASE_FILES_SQL} SELECT DISTINCT path FROM files WHERE regexp_matches(path, '/log[.][^/]+$') AND NOT regexp_matches(path, '(^|/)(processor|[.])[^/]*/')")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return corpus.case_logs(case_files(spark, d))


@query("q06_probe_fields", f"WITH {CASE_FILES_SQL} SELECT DISTINCT regexp_extract(path, '^(.*)/postProcessing/probes/[^/]+/([^/]+)$', 1) AS \"case\", regexp_extract(path, '^(.*)/postProcessing/probes/[^/]+/([^/]+)$', 2) AS field FROM files WHERE size > 0 AND contains(path, '/postProcessing/probes/')")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return corpus.probe_fields(case_files(spark, d), "probes")


@query("q07_owner", f"WITH {CASE_FILES_SQL}, {CASES_SQL} SELECT path, max(\"case\") AS owner FROM files LEFT JOIN cases ON starts_with(path, \"case\" || '/') GROUP BY path")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return corpus.longest_owner(case_files(spark, d).select("path").distinct(), case_dirs(spark, d))


NAMES = ("the", "ander", "TION", "keit")


@query("q08_identifier_search", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_docs, sum(doc_id) AS sum_ids FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){n}([^A-Za-z0-9_]|$)')" for n in NAMES))
def q08(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d)
    found = docs.select("doc_id", F.explode(F.array(*[F.when(T.present(F.col("text"), n), F.lit(n)) for n in NAMES])).alias("name"))
    some = found.where("name is not null").groupBy("name").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("sum_ids"))
    return spark.createDataFrame([(n,) for n in NAMES], "name string").join(some, "name", "left").select("name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "sum_ids")


GLOBS = ("**/en/*", "es/**", "*1*", "f?/**")


@query("q09_glob", f"""
WITH u AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
g(pattern, re) AS (VALUES {', '.join(f"('{g}', '{T.glob_regex(g)}')" for g in GLOBS)}),
m AS (SELECT pattern, path, page_id, row_number() OVER (PARTITION BY pattern ORDER BY path, page_id) - 1 AS k, count(*) OVER (PARTITION BY pattern) AS n FROM u JOIN g ON regexp_matches(path, re))
SELECT pattern, path, page_id, k // 20 AS page, CASE WHEN (k // 20 + 1) * 20 < n THEN (k // 20 + 1) * 20 END AS next_offset FROM m""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1).alias("path"))
    hits = paths.select("page_id", "path", F.explode(F.array(*[F.when(F.col("path").rlike(T.glob_regex(g)), F.lit(g)) for g in GLOBS])).alias("pattern")).where("pattern is not null")
    n = hits.groupBy("pattern").agg(F.count("*").alias("n"))
    paged = ranges.numbered(hits, ["path", "page_id"], ["pattern"]).join(F.broadcast(n), "pattern").withColumn("page", F.floor((F.col("place") - 1) / 20))  # a row a pattern
    nxt = (F.col("page") + 1) * 20
    return paged.select("pattern", "path", "page_id", "page", F.when(nxt < F.col("n"), nxt).alias("next_offset"))


GREP = r"(?i)(licen[sc]e|token|password|@[a-z]+)"


@query("q10_grep", f"SELECT doc_id, CAST(i AS INTEGER) AS line, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE length(text) > 0)) WHERE regexp_matches(l[i], '{GREP}')")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return corpus.numbered_lines(texts(spark, d)).where(F.col("text").rlike(GREP))


def _sql(s: str) -> str:
    return s.replace("'", "''")


_REDACT = f"""array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN regexp_matches(x, '{_sql(T.ASSIGNMENT)}') AND lower(regexp_extract(x, '{_sql(T.ASSIGNMENT)}', 2)) <> 'authorization'
 AND regexp_matches(regexp_extract(x, '{_sql(T.ASSIGNMENT)}', 2), '{_sql(T.SENSITIVE_KEY)}') THEN regexp_replace(x, '{_sql(T.ASSIGNMENT)}', '\\1\\2\\3<REDACTED>') ELSE x END), chr(10))"""
for _p, _r in ((T.BEARER, r"\1<REDACTED>"), (T.JSON_KEY + r'"[^"\r\n]*"', r'\1"<REDACTED>"'), (T.JSON_KEY + r"'[^'\r\n]*'", r"\1'<REDACTED>'"), (T.JSON_KEY + r"[^\s,}\]\"'][^\s,}\]]*", r"\1<REDACTED>"), (T.TOKEN_PREFIX, "<REDACTED>")):
    _REDACT = f"regexp_replace({_REDACT}, '{_sql(_p)}', '{_sql(_r)}', 'g')"


@query("q11_redaction", f"SELECT doc_id, sha256(r) AS redacted_sha256, CAST((length(r) - length(replace(r, '<REDACTED>', ''))) // 10 AS BIGINT) AS n_redacted FROM (SELECT doc_id, {_REDACT} AS r FROM documents)")
def q11(spark: SparkSession, d: str) -> DataFrame:
    done = texts(spark, d).select("doc_id", T.redact(F.col("text")).alias("r"))
    n = F.floor((F.length("r") - F.length(F.replace("r", F.lit("<REDACTED>"), F.lit("")))) / 10)
    return done.select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("redacted_sha256"), n.alias("n_redacted"))


@query("q12_passages", f"WITH RECURSIVE {PASSAGES_SQL} SELECT doc_id, \"start\", \"end\", passage_id, sha256(text) AS text_sha256 FROM passages")
def q12(spark: SparkSession, d: str) -> DataFrame:
    return ranking.passages(texts(spark, d)).select("doc_id", "start", "end", "passage_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("q13_bm25", f"WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL} SELECT item_id, passage_id, doc_id, \"start\", \"end\", score, rank FROM hits WHERE rank <= 10")
def q13(spark: SparkSession, d: str) -> DataFrame:
    return item_hits(spark, d, 10).select("item_id", "passage_id", "doc_id", "start", "end", "score", F.col("rank").cast("long").alias("rank"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = table(spark, d, "benchmark").select("item_id").distinct().join(vectors.select(F.col("doc_id").alias("item_id"), "embedding"), "item_id")
    return ranking.dense(vectors, queries, "doc_id", "item_id")


_DENSE_SQL = """
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))), 6) AS score
    FROM embeddings v JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 64)
"""


@query("q14_dense", f"WITH {_DENSE_SQL} SELECT item_id, doc_id, score, rank FROM dense")
def q14(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("q16_fusion", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL}, {_DENSE_SQL},
each AS (SELECT item_id, doc_id, min(rank) AS rank FROM hits GROUP BY ALL UNION ALL SELECT item_id, doc_id, min(rank) FROM dense GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM each GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 64""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    hits = item_hits(spark, d).select("item_id", "doc_id", "rank")
    fused = ranking.fuse([hits, _dense(spark, d).select("item_id", "doc_id", "rank")], "doc_id", "item_id")
    return fused.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_lists(spark: SparkSession, d: str) -> DataFrame:
    """Passages of each item by BM25, by vectors of their documents, and by literals, fused; those seen or out of scope are left out.

    A document's vector stands for its first passage.  The three best BM25
    passages of items with even ids count as seen; items with an id divisible
    by 3 are confined to two sources.
    """
    units = ranking.passages(texts(spark, d), keep=("source",)).withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    items = table(spark, d, "benchmark").select("item_id", "text")
    lexical = item_hits(spark, d).select("item_id", "passage_id", "rank")
    firsts = units.where("start = 1").groupBy("doc_id").agg(F.min("passage_id").alias("passage_id"))
    dense = _dense(spark, d).join(firsts, "doc_id").select("item_id", "passage_id", "rank")
    literal = ranking.literal_hits(units.select("passage_id", "source", "text"), items, "passage_id", "item_id", path="source").select("item_id", "passage_id", "rank")
    fused = ranking.fuse([lexical, dense, literal], "passage_id", "item_id", pool=192).drop("rank")
    seen = lexical.where("item_id % 2 = 0 and rank <= 3")
    fresh = selection.unseen(fused, seen, ["item_id", "passage_id"]).join(units.select("passage_id", "doc_id", "start", "end", "path"), "passage_id")
    scopes = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("src1"), F.lit("src2/"))).otherwise(F.array().cast("array<string>"))
    kept = fresh.where(selection.in_scope(F.col("path"), scopes))
    return ranking.top(kept, ["item_id"], [F.desc("score"), F.asc("passage_id")], 192).drop("path")


@query("q15_hybrid")
def q15(spark: SparkSession, d: str) -> DataFrame:
    """The fused passages of each item after suppression of overlaps: sequential, so it has no SQL."""
    return ranking.suppress_overlaps(hybrid_lists(spark, d), "item_id", keep=32, pool=192).select("item_id", "passage_id", "doc_id", "start", "end", "score", "rank")


@query("q17_diversity", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL},
e AS (SELECT item_id, passage_id, doc_id, round(score / (1 + 0.25 * (row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, passage_id) - 1)), 9) AS effective FROM hits)
SELECT item_id, passage_id, effective, row_number() OVER (PARTITION BY item_id ORDER BY effective DESC, passage_id) AS place FROM e""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversified(item_hits(spark, d), "item_id", "doc_id", "passage_id").select("item_id", "passage_id", "effective", F.col("place").cast("long").alias("place"))


@query("q18_delivery", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL},
each AS (SELECT item_id, doc_id, line, min(rank) AS slot FROM (SELECT item_id, doc_id, rank, unnest(range("start", "end" + 1)) AS line FROM hits WHERE rank <= 10) GROUP BY ALL),
isl AS (SELECT *, line - row_number() OVER (PARTITION BY item_id, slot, doc_id ORDER BY line) AS island FROM each),
r AS (SELECT item_id, slot, doc_id, min(line) AS "start", max(line) AS "end" FROM isl GROUP BY item_id, slot, doc_id, island),
b AS (SELECT *, sum("end" - "start" + 1) OVER (PARTITION BY item_id ORDER BY slot, doc_id, "start" ROWS UNBOUNDED PRECEDING) AS spent FROM r)
SELECT item_id, slot, doc_id, "start", "end", CAST(spent AS BIGINT) AS spent FROM b WHERE spent <= 60""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    slots = item_hits(spark, d, 10).withColumnRenamed("rank", "slot")
    given = ranges.deliver_lines(slots, "item_id", "doc_id")
    cost = (F.col("end") - F.col("start") + 1).cast("long")
    kept = ranges.within_budget(given, ["item_id"], [F.col("slot"), F.col("doc_id"), F.col("start")], cost, 60)
    return kept.select("item_id", F.col("slot").cast("long").alias("slot"), "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "spent")


@query("q19_merged_ranges", f"""WITH RECURSIVE {PASSAGES_SQL}, {HITS_SQL},
x AS (SELECT item_id, doc_id, greatest(1, "start" - 8) AS s, "end" + 8 AS e FROM hits),
m AS (SELECT *, CASE WHEN s > max(e) OVER w + 1 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY item_id, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT item_id, doc_id, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end", count(*) AS n FROM i GROUP BY item_id, doc_id, island""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    low, high = ranges.expand("start", "end", 8, F.lit(1), F.lit(1 << 30))
    wide = item_hits(spark, d).select("item_id", "doc_id", low.alias("start"), high.alias("end"))
    return ranges.merge_ranges(wide, ["item_id", "doc_id"]).select("item_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


@query("q23_range_overlap", f"""WITH RECURSIVE {PASSAGES_SQL}, a AS (SELECT doc_id, doc_id % 13 + 1 AS a_start, doc_id % 13 + 1 + doc_id % 29 AS a_end FROM documents)
SELECT doc_id, a_start, a_end, CAST("start" AS BIGINT) AS b_start, CAST("end" AS BIGINT) AS b_end FROM a JOIN passages USING (doc_id) WHERE greatest(a_start, "start") <= least(a_end, "end")""")
def q23(spark: SparkSession, d: str) -> DataFrame:
    docs, i = texts(spark, d), F.col("doc_id")
    a = docs.select("doc_id", (i % 13 + 1).alias("a_start"), (i % 13 + 1 + i % 29).alias("a_end"))
    b = ranking.passages(docs).select("doc_id", F.col("start").cast("long").alias("b_start"), F.col("end").cast("long").alias("b_end"))
    return ranges.overlap_join(a, b, ["doc_id"]).select("doc_id", "a_start", "a_end", "b_start", "b_end")


@query("q28_sections", f"""
WITH h AS (SELECT doc_id, CAST(i AS INTEGER) AS line, 1 + length(l[i]) % 3 AS level, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE length(text) > 0)) WHERE length(l[i]) < 60)
SELECT a.doc_id, a.line, CAST(a.level AS INTEGER) AS level, CAST(coalesce(min(b.line) - 1, any_value(a.n)) AS INTEGER) AS section_end FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line > a.line AND b.level <= a.level GROUP BY a.doc_id, a.line, a.level""")
def q28(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d)
    n = docs.where(F.length("text") > 0).select("doc_id", F.size(T.lines(F.col("text"))).alias("n"))
    heads = corpus.numbered_lines(docs).where(F.length("text") < 60).select("doc_id", "line", (F.length("text") % 3 + 1).alias("level")).join(n, "doc_id")
    return ranges.section_ends(heads, "doc_id", F.col("n")).select("doc_id", "line", "level", "section_end")


@query("q29_terms", "SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z_][a-z_0-9]*|[0-9]+'))), ' ')) AS terms_sha256, CAST(len(" + tokens_sql("text") + ") AS BIGINT) AS n_tokens FROM documents")
def q29(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d)
    return docs.select("doc_id", F.sha2(F.array_join(T.terms(F.col("text")), " ").cast("binary"), 256).alias("terms_sha256"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("q27_facet_greedy")
def q27(spark: SparkSession, d: str) -> DataFrame:
    """Passages chosen for score, new query terms and other documents: sequential, so it has no SQL."""
    hits = cut(item_hits(spark, d), "hits")
    # only what was hit is read for its terms, so no other text is shuffled
    sent = F.broadcast if hits.count() <= ranking.BROADCAST_TERMS else (lambda x: x)
    docs = texts(spark, d).join(sent(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    units = ranking.passages(docs).join(sent(hits.select("passage_id").distinct()), "passage_id", "left_semi").select("passage_id", T.terms(F.col("text")).alias("facets"))
    asked = table(spark, d, "benchmark").select("item_id", T.terms(F.col("text")).alias("asked"))
    pool = hits.join(units, "passage_id").join(asked, "item_id").withColumn("facets", F.array_intersect("facets", "asked")).select("item_id", "passage_id", "doc_id", "score", "facets")
    return ranking.facet_greedy(pool, "item_id", "passage_id", "doc_id").select("item_id", "passage_id", "doc_id", "score", "place")


@query("q38_normalized", r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(url, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[-_]', ' ', 'g')), '[^a-z0-9./]', ' ', 'g'), ' +', ' ', 'g')) AS norm, trim(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS safe FROM pages")
def q38(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.normalized(F.col("url")).alias("norm"), T.safe_name(F.col("url")).alias("safe"))


@query("q39_markup_entries")
def q39(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the style blocks of pages by the parser of nested blocks; no SQL has its stack."""
    from tessera.operators.structure import dictionary_entries

    styles = table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<style>(.*?)</style>"), F.lit(1)), "\n").alias("text"))
    return dictionary_entries(styles, keep=("page_id",))
