"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontam, langid, merkle, neardup, quality, sharding, spotsigs, tokenbin, toxicity, triebpe, urlfilter, vectorcodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_both(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    learned = langid.learn_languages(docs.where(~held_out))
    found = langid.identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), learned)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


#: (verdict, host, path prefix)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = common.made_folder(spark, "tokens")
    manifest = tokenbin.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json")).collect()
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return tokenbin.read_token_files(spark, folder, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), size=10, unnamed=True)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "content_score", "metadata_score", "score", "accepted")


#: Categories of the chain, in order.  The labels tell toxic texts from others and good texts from poor
#: ones, so the first two links are toxic noise and toxic prose, and the last is any toxicity.
TOXIC_CATEGORIES = ["toxic_noise", "toxic_prose", "toxic"]


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select(
        "doc_id",
        ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("toxic_noise"),
        ((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("toxic_prose"),
        (F.col("toxic") == 1).alias("toxic"),
    )
    chain = toxicity.train_toxicity(docs, labels, TOXIC_CATEGORIES)
    return toxicity.score_toxicity(docs, chain).select("doc_id", *[f"{c}_score" for c in TOXIC_CATEGORIES], "flagged")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = spotsigs.with_next(spotsigs.add_fingerprint(docs), ["text", "sketch"])
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut))
    both = spotsigs.add_fingerprint(marked.withColumn("edited", edited), "edited", "edited_sketch")
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sketch")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        spotsigs.likeness(F.col("sketch"), F.coalesce("next_sketch", "sketch")).alias("near_next"),
    )


def op9_spot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.spot_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_key"),
    )
    return sharding.shard_groups(docs, "text_key", "size", 40, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectorcodes.learn_codebooks(vectors, "vec_id", "embedding")
    coded = common.written(vectorcodes.assign_codes(vectors, books, "embedding").select("vec_id", "label", "code", "error"), "codes")
    digest = F.sha2(F.lit(books.text()).cast("binary"), 256)  # of entries x dimension numbers
    totals = vectorcodes.with_key_total(coded, "label", "error", "label_error")
    return totals.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    of = lambda n: merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")])
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = F.unhex(F.when(altered, of(F.col("n_chars") + 1)))
    found = merkle.merkle_manifest(docs, of(F.col("n_chars")), "lang", "doc_id", tampered)
    hexed = lambda c: F.lower(F.hex(c))
    again = merkle.folded(F.coalesce("row", "leaf"), *[F.col(c) for c in ("at", "n", "group_at", "groups", "path")])
    return found.withColumn("folded", again).select(
        F.col("key").alias("doc_id"),
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        F.sha2(hexed("path").cast("binary"), 256).alias("proof_sha256"),
        hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = triebpe.trie_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return triebpe.trie_decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_minhash": op4_minhash,
    "op5_token_files": op5_token_files,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_spotsigs": op9_spotsigs,
    "op9_spot_classes": op9_spot_classes,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle": op12_merkle,
    "op13_trie_bpe": op13_trie_bpe,
}

ORACLE: dict[str, str] = {
    "op3_url_filter": r"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
        FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit ON u.r = fit.r AND k = 1
""",
    # windows of ten words of items, or the whole of a shorter one, against the documents' windows of as many words
    "op6_decontaminate": r"""
WITH dw AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
win AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= m)),
occ AS (SELECT r, i, win.m, item_id FROM win JOIN pat ON win.m = pat.m AND win.p = pat.p),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
""".replace("\\\\", "\\"),
}
