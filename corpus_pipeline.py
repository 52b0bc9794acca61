"""A training corpus from `documents`, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before has
kept, whole texts however long, and calls one operator.  Columns of ``docs``
other than the five named here are dropped; an empty table gives an empty table.  Between stages the rows are written as Parquet to
the folder that driver and executors share, and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, neardup, quality
from tessera.llm.common import written
from tessera.llm.queries import table

#: Rows of whole texts that lie in a worker's memory at a time, several times over, while they are encoded.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL expresses the trained classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; rows that repeat are judged each, null texts as empty."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("accepted").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's dictionary compresses clearly best go, so do null texts and those without a letter."""
    learned = langid.learn_languages(docs)
    return langid.identify_language(docs, learned).where("accepted").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least id stays.

    Rows of one id are one document: the row with the least text stays, of rows
    with the same text too.  Rows without an id are no documents that another could stand for, and stay.
    """
    found = written(neardup.near_duplicates(docs, words=5, percent=80), "near-duplicates")
    gone = neardup.few(written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    left = docs.select(COLUMNS).join(gone, "doc_id", "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    rest = [F.min_by(F.struct(*COLUMNS), F.struct("text", "lang", "source", "n_chars")).alias("r")]
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(*rest).select("r.*")
    return left.join(again, "doc_id", "left_anti").unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go; null and empty texts have none and stay."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.find_contamination(docs, items, size=10, unnamed=True).where(F.size("hit_spans") == 0).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and digests of the ids and of what they decode to; null counts as empty.

    Texts, ids and decoded bytes go between Spark and its workers in batches of at most ``BATCH_ROWS`` rows,
    for which the session is set from here on.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.bpe_both(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
