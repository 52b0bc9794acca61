"""Structured Streaming forms of the tailing consumers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.functions.text import anomaly
from tessera.sources.tail import CHUNK, AppendedLines


def tail_lines(spark: SparkSession, path: str, match: str = "*", chunk_bytes: int = CHUNK) -> DataFrame:
    """``(path, position, value)`` of whole lines as they are appended to the files below ``path``, over restarts too."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("match", match).option("chunkBytes", chunk_bytes).load(path)


def tail_events(spark: SparkSession, path: str, schema: str | StructType, match: str = "*") -> DataFrame:
    """Rows of JSON lines as they are appended; a line that is no such object gives nulls."""
    return tail_lines(spark, path, match).select(F.from_json("value", schema).alias("e")).select("e.*")


def progress(events: DataFrame, by: list[str]) -> DataFrame:
    """Running counts for each key; for update or complete mode, and for batches."""
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def paired(left: DataFrame, right: DataFrame, on: str, time: str = "ts", within: str = "7 days") -> DataFrame:
    """Means of two judges' values, each given once both have come.

    ``left`` and ``right`` have ``on``, ``time`` and ``value``; state older than ``within`` goes.
    """
    a = left.withWatermark(time, within).select(F.col(on).alias("key_a"), F.col(time).alias("ts_a"), F.col("value").alias("value_a"))
    b = right.withWatermark(time, within).select(F.col(on).alias("key_b"), F.col(time).alias("ts_b"), F.col("value").alias("value_b"))
    near = (F.col("key_a") == F.col("key_b")) & (F.col("ts_a") >= F.col("ts_b") - F.expr(f"interval {within}")) & (F.col("ts_a") <= F.col("ts_b") + F.expr(f"interval {within}"))
    return a.join(b, near).select(F.col("key_a").alias(on), ((F.col("value_a") + F.col("value_b")) / 2).alias("mean"))


def guarded(log: DataFrame, job: str, budget: float) -> DataFrame:
    """``(job, seq, kind)``: where each job's log is stopped, once.

    ``log`` has ``job, seq, seconds, text``.  A job stops at its first anomaly
    or where its seconds exceed ``budget``; rows after that change nothing,
    over restarts too.
    """
    out, state = f"{job} long, seq long, kind string", "stopped boolean, spent double"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        stopped, spent = held.get if held.exists else (False, 0.0)
        rows = pd.concat(list(batches)).sort_values("seq")
        found = []
        for seq, seconds, kind in zip(rows["seq"], rows["seconds"], rows["kind"]):
            if stopped:
                break
            spent += float(seconds)
            kind = kind if isinstance(kind, str) else "budget_exceeded" if spent > budget else None
            if kind:
                stopped = True
                found.append((key[0], seq, kind))
        held.update((stopped, spent))
        yield pd.DataFrame(found, columns=[job, "seq", "kind"])

    marked = log.select(job, "seq", "seconds", anomaly(F.col("text")).alias("kind"))
    return marked.groupBy(job).applyInPandasWithState(follow, out, state, "append", GroupStateTimeout.NoTimeout)
