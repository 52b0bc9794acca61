"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What a Python worker keeps under ``key`` between batches and tasks.

    Workers outlive the steps of a job, so a worker keeps one thing only: when
    another step begins, the tables of the one before are freed.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def made_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared one that exists, as a URI with its scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_path(spark, tag))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def shared_file(spark: SparkSession, local: str, tag: str) -> str:
    """Copy a file of the driver into the shared folder; returns its URI."""
    folder = made_folder(spark, tag)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{local.rpartition('/')[2]}")
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(source, path)
    return path.toString()


#: Rows of a few numbers up to which a table is brought into few files, and how many of them a file holds.
SMALL_TABLE, FILE_ROWS = 1_000_000, 200_000


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    ``rows`` is a bound of their number where one is known: a small table of a
    few numbers is shuffled into few files, instead of one for each partition.
    """
    if rows is not None and rows <= SMALL_TABLE:
        df = df.repartition(max(1, -(-rows // FILE_ROWS)))
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers up to which a table of ids is sent to all executors instead of shuffling all texts.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """``ids``, a written table, to be sent to all tasks if it has at most ``BROADCAST_IDS`` rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_written(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` as ``(id, component)``.

    ``component`` is the smallest id reachable.  Alternating large-star and
    small-star steps: each round is two shuffles with map-side ``min``, the
    number of rounds grows with the logarithm of the longest path, and each
    round's edges are a written table.  Self links are allowed and keep lone
    ids in the result.
    """
    n = edges.count()
    nodes = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "cc-nodes", 2 * n)
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", n
    )
    seen = None
    for _ in range(max_rounds):
        # large star: link every larger neighbour of a node to the least neighbour
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: link a node and its smaller neighbours to the least of them
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = written(small, "cc", n)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(cur)
        cur, n = nxt, max(n, state[0])
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("component")
    )
