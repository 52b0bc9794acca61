"""Sinks: exclusive creation, replacement, event logs, reports and manifests of what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def create(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write to a path that must not exist."""
    df.write.mode("errorifexists").format(kind).save(path)


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write beside ``path`` and rename: readers see the old files, for a moment none, or the new ones.

    Where the new files can't be put in place the old ones are put back.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = hadoop(f"{path}.new-{uuid.uuid4().hex}"), hadoop(f"{path}.old-{uuid.uuid4().hex}")
    df.write.format(kind).save(new.toString())
    target = hadoop(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"could not put {path} in place")
    if fs.exists(old):
        fs.delete(old, True)


def publish(tables: dict[str, DataFrame], kind: str = "parquet", most: int = 64) -> None:
    """Write several tables and put all of them in place, or none.

    All are written beside their paths first.  Where one can't be put in place, those
    already there go and the old ones come back.  Each path may be there before or not.
    """
    if len(tables) > most:
        raise ValueError(f"{len(tables)} tables at once; at most {most}")
    if not tables:
        return
    spark, tag = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    plan = [(hadoop(path), hadoop(f"{path}.new-{tag}"), hadoop(f"{path}.old-{tag}")) for path in tables]
    done = []
    try:
        for df, (_, new, _) in zip(tables.values(), plan):
            df.write.format(kind).save(new.toString())
        for target, new, old in plan:
            fs = target.getFileSystem(conf)
            done.append((fs, target, new, old))
            if fs.exists(target) and not fs.rename(target, old):
                raise OSError(f"could not move {target.toString()} away")
            if not fs.rename(new, target):
                raise OSError(f"could not put {target.toString()} in place")
    except Exception:
        for fs, target, new, old in reversed(done):
            if not fs.exists(new) and fs.exists(target):
                fs.delete(target, True)
            if fs.exists(old):
                fs.rename(old, target)
        raise
    finally:
        for target, new, old in plan:
            fs = target.getFileSystem(conf)
            for rest in (new, old) if fs.exists(target) else (new,):
                if fs.exists(rest):
                    fs.delete(rest, True)


def append_events(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def report(df: DataFrame, title: str, by: str, columns: list[str]) -> DataFrame:
    """``(by, report)``: a Markdown table of the rows of each group, ordered by their cells."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return df.groupBy(by).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(row)), "\n")).alias("report"))


def manifest(spark, path: str) -> DataFrame:
    """``(path, sha256, bytes)`` of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
