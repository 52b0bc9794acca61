"""Candidates without content, and the details of chosen ones from a bucketed store.

A candidate's id is a hash of what it stands for, so it is the same in each run
and needs no register.  Details are written once, bucketed and sorted by id, and
later look-ups shuffle the ids only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalized


def result_id(kind: str, *payload: Column) -> Column:
    """``kind:`` and 16 hex digits of the payload's canonical JSON."""
    body = F.to_json(F.struct(F.lit(kind).alias("kind"), *[c.alias(f"k{k}") for k, c in enumerate(payload)]))
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(body.cast("binary")), 1, 16))


def write_details(details: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Write ``details (result_id, ..)`` as the table ``name`` at ``path``, bucketed by id."""
    details.write.bucketBy(buckets, "result_id").sortBy("result_id").option("path", path).mode("errorifexists").format("parquet").saveAsTable(name)


def look_up(spark: SparkSession, name: str, chosen: DataFrame) -> DataFrame:
    """``chosen (.., result_id)`` with ``found`` and the details; an unknown id is not found.

    The ids are dealt out by the table's buckets, which stay where they are.
    """
    stored = spark.table(name)
    rest = [c for c in stored.columns if c != "result_id"]
    held = stored.select(F.col("result_id").alias("_id"), *rest, F.lit(True).alias("_there"))
    return chosen.join(held.hint("merge"), F.col("result_id") == F.col("_id"), "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_id", "_there")


def one_detail(spark: SparkSession, name: str, ids: list[str]) -> DataFrame:
    """The details of a few ids, one row each, read from their buckets only."""
    # grouping by the bucket column keeps the scan bucketed, and so the other buckets out of it
    return spark.table(name).where(F.col("result_id").isin(*ids)).dropDuplicates(["result_id"])


def find_variables(asked: DataFrame, entries: DataFrame, case: str = "case") -> DataFrame:
    """``asked (.., case, name)`` with the ``entries (case, file, key, path, ..)`` of which key or path, both normalised, is the name.

    The two names of an entry are one equi-join with the case; an entry whose
    key and path are alike comes once.
    """
    names = F.array_distinct(F.array(normalized(F.col("key")), normalized(F.col("path"))))
    known = entries.withColumn("_n", F.explode(names)).withColumnRenamed(case, "_case")
    wanted = asked.withColumn("_n", normalized(F.col("name")))
    return wanted.join(known, (wanted[case] == known["_case"]) & (wanted["_n"] == known["_n"])).drop("_n", "_case")
