"""Releases of several tables behind one pointer.

A release is a folder of its own, written and checked before anybody sees it.
Readers find it by the pointer, a small file that is replaced in one step, so
they have the old release or the new one, whole, and never none.  The pointer is
moved only if it still says what the publisher began with, and only if the
sources still have the digests from which the release was made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut
from tessera.sources.sinks import manifest

POINTER, LOCK = "current.json", "current.lock"


class Conflict(RuntimeError):
    """Another publisher was first, or a source has changed."""


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path, path(root).getFileSystem(conf), conf


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: ``release`` and ``tables``; None where nothing was published."""
    path, fs, _ = _files(spark, root)
    at = path(f"{root}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_release(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the release that the pointer names now."""
    said = pointer(spark, root)
    if said is None or table not in said["tables"]:
        raise ValueError(f"no release of {table} in {root}")
    return spark.read.parquet(f"{root}/releases/{said['release']}/{table}")


def changed_sources(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """``(path, change)``: files below ``path`` that are added, removed or changed against ``known (path, sha256)``."""
    now = manifest(spark, path).select("path", F.col("sha256").alias("now"))
    both = known.select("path", "sha256").join(now, "path", "full")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def publish_release(
    tables: dict[str, DataFrame], root: str, began: dict | None, check: Callable[[dict[str, DataFrame]], None] | None = None, sources: tuple[str, DataFrame] | None = None
) -> str:
    """Write ``tables``, have them checked, and point to them; returns the release's name.

    ``began`` is what ``pointer`` said when the work began; ``check`` gets the written
    tables and raises where they are wrong; ``sources`` is a path and the manifest
    that the work was made from.  Where any of these fails the pointer stays.
    """
    spark = next(iter(tables.values())).sparkSession
    path, fs, conf = _files(spark, root)
    release = uuid.uuid4().hex
    folder = path(f"{root}/releases/{release}")
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/releases/{release}/{name}")
        if check:
            check({name: spark.read.parquet(f"{root}/releases/{release}/{name}") for name in tables})
        _point(spark, root, began, {"release": release, "tables": sorted(tables)}, sources)
    except Exception:
        fs.delete(folder, True)
        raise
    return release


def _point(spark: SparkSession, root: str, began: dict | None, to: dict, sources: tuple[str, DataFrame] | None) -> None:
    path, fs, conf = _files(spark, root)
    lock, new, at = path(f"{root}/{LOCK}"), path(f"{root}/.{uuid.uuid4().hex}"), path(f"{root}/{POINTER}")
    # creating a file that must not exist is one step in each file system of Hadoop's that has a name node or a local disk
    try:
        fs.create(lock, False).close()
    except Exception as e:
        raise Conflict(f"another publisher holds {lock.toString()}") from e
    try:
        if pointer(spark, root) != began:
            raise Conflict("another release was published meanwhile")
        if sources and not changed_sources(spark, *sources).isEmpty():
            raise Conflict("a source has changed since the work began")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(to, sort_keys=True).encode()))
        out.close()
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)
        kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(at), kinds)
    finally:
        fs.delete(new, False)
        fs.delete(lock, False)


def rebuild(spark: SparkSession, root: str, path: str, parse: Callable[[DataFrame], DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> dict:
    """Publish what ``parse`` gives for the files below ``path``, parsing only those that are new or changed.

    ``parse`` takes ``(path, content)`` and returns rows with ``path``.  Rows of
    unchanged files come from the release before.  Nothing is published where no
    file differs.  Returns ``status`` and the numbers of files parsed, reused and removed.
    """
    began = pointer(spark, root)
    now = cut(manifest(spark, path).select("path", "sha256"), "manifest")
    if began is None:
        stale, kept_rows, removed = now, None, 0
    else:
        known = read_release(spark, root, "files")
        stale = cut(now.join(known, ["path", "sha256"], "left_anti"), "stale")
        removed = known.join(now, "path", "left_anti").count()
        kept_rows = read_release(spark, root, "rows").join(now.join(known, ["path", "sha256"]).select("path"), "path", "left_semi")
    parsed, every = stale.count(), now.count()
    if began is not None and not parsed and not removed:
        return {"status": "unchanged", "parsed": 0, "reused": every, "removed": 0}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = [parse(files.join(stale.select("path"), "path", "left_semi")), *([kept_rows] if kept_rows is not None else [])]
    publish_release({"files": now, "rows": reduce(DataFrame.unionByName, rows)}, root, began, check, (path, now))
    return {"status": "published", "parsed": parsed, "reused": every - parsed, "removed": removed}
