"""Merkle trees over ordered rows, one for each group and one over the groups.

A row's leaf is the hash of its columns.  The leaves of a group stand in order;
while a group has several nodes, every ``arity`` consecutive ones (the last run
may be shorter, even of one) become their hash.  The nodes that remain, in the
order of their groups, become the root in the same way.

Trees grow by events.  A digest that arrives at a node waits there, with its
index, for its siblings; as the number of leaves tells how many children each
node has, the last one to arrive makes the parent's digest, which arrives one
level up.  ``combineByKey`` runs this for blocks of ``arity ** STRIDE``
consecutive nodes: each task folds what it has of a block, in any order, and
only the open parents wait for the other tasks' halves.  The blocks' tops are
the frontier that no task can settle; they are keyed anew by the blocks above
them and reshuffled, until each group has one node.  Each round keeps its
blocks in a written table, so links are followed back from the top: a block
gives each of its lower nodes the siblings on the way to the root.

A task holds one block at a time, of bounded size; texts are hashed where they
are read and never shuffled.  Rows with equal groups and order keys are ordered
by their leaves, and wholly alike ones can change places.  A null group is a
group, before all others; null order keys come first; null columns have their
own mark in the leaf.  Long texts are hashed whole.  An empty table gives an
empty table.  Columns other than the named ones are dropped, so they may have
any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import few, written

#: Levels of a block: a block has at most ``arity ** STRIDE`` lower nodes.
STRIDE = 10


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def hash_of(digests: list[bytes]) -> bytes:
    """The digest of digests, which go in as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def nodes_at(level: int, leaves: int, arity: int) -> int:
    """Nodes of a level over so many leaves."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows``, written, with ``at`` (from 0) and ``n``, by ``order`` within each ``group`` (no nulls in it).

    Rows are dealt out by ranges of group and order, so a large group lies in
    many tasks; counts of each task and group give where its rows begin.
    """
    keys = [F.col(group), *[F.asc_nulls_first(c) for c in order], F.col("_m")]
    # rows that are wholly alike may be many: their number splits them
    dealt = rows.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("_m", 33)
    counts = placed.groupBy(group, task.alias("_p")).agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy(group))})
    sent = few(written(counts.drop("_c"), "ranges"))
    return placed.withColumn("_p", task).join(sent, [group, "_p"]).withColumn("at", F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_p", "_before", "_first")


class Block:
    """Nodes of one block that are known, and parents whose children have not all arrived."""

    def __init__(self, n: int, base: int, arity: int, stride: int):
        self.n, self.base, self.arity = n, base, arity
        sizes = [nodes_at(base, n, arity)]
        while len(sizes) <= stride and sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // arity))
        self.sizes = sizes
        self.known: list[dict[int, bytes]] = [{} for _ in sizes]
        self.open: dict[tuple[int, int], dict[int, bytes]] = {}
        self.rows: dict[int, object] = {}

    def arrive(self, level: int, at: int, digest: bytes) -> None:
        """An event; when it is a parent's last child, the parent's digest is the next."""
        while True:
            self.known[level][at] = digest
            if level + 1 == len(self.sizes):
                return
            up = at // self.arity
            waiting = self.open.setdefault((level, up), {})
            waiting[at] = digest
            if len(waiting) < min(self.arity, self.sizes[level] - up * self.arity):
                return
            del self.open[level, up]
            level, at, digest = level + 1, up, hash_of([waiting[k] for k in sorted(waiting)])

    def merge(self, other: Block) -> Block:
        """What another task has of the block: its open parents' children arrive here."""
        self.rows.update(other.rows)
        for own, more in zip(self.known, other.known):
            own.update(more)
        for (level, _), waiting in other.open.items():
            for at, digest in waiting.items():
                self.arrive(level, at, digest)
        return self

    def siblings(self, at: int) -> bytes:
        """Digests beside the way from a lower node to the block's top, by level, left to right."""
        out = []
        for level in range(len(self.sizes) - 1):
            first = at // self.arity * self.arity
            out += [self.known[level][k] for k in range(first, min(first + self.arity, self.sizes[level])) if k != at]
            at //= self.arity
        return b"".join(out)


def _blocks(events: DataFrame, base: int, arity: int, stride: int, carry: T.DataType) -> DataFrame:
    """``(g, n, at, low array<binary>, rows array, top binary)``: the blocks above the nodes ``(g, n, at, digest, row)`` of one level."""
    span = arity**stride

    def event(r):
        return (r["g"], r["n"], r["at"] // span), (r["at"], bytes(r["digest"]), r["row"])

    def added(block: Block, value) -> Block:
        at, digest, row = value
        block.rows[at] = row
        block.arrive(0, at, digest)
        return block

    def created(value) -> Block:
        at, digest, row, n = value
        return added(Block(n, base, arity, stride), (at, digest, row))

    def done(pair):
        (g, n, at), block = pair
        if block.open or len(block.known[-1]) != 1:
            raise RuntimeError("a block's children did not all arrive")
        order = sorted(block.known[0])
        return g, n, at, [block.known[0][k] for k in order], [block.rows[k] for k in order], next(iter(block.known[-1].values()))

    spark = events.sparkSession
    pairs = events.select("g", "n", "at", "digest", "row").rdd.map(event).map(lambda kv: (kv[0], (*kv[1], kv[0][1])))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = pairs.combineByKey(created, lambda b, v: added(b, v[:3]), Block.merge, tasks, lambda key: xxhash.xxh32_intdigest(repr(key)))
    schema = T.StructType().add("g", "string").add("n", "long").add("at", "long").add("low", T.ArrayType(T.BinaryType())).add("rows", T.ArrayType(carry)).add("top", "binary")
    return written(spark.createDataFrame(built.map(done), schema, verifySchema=False), "merkle-blocks")


def grow(nodes: DataFrame, arity: int, stride: int) -> list[DataFrame]:
    """The block tables of each round over ``nodes (g, n, at, digest, row)``, lowest first."""
    most = nodes.agg(F.max("n")).first()[0]
    tables, carry, base = [], nodes.schema["row"].dataType, 0
    while most is not None and (not tables or nodes_at(base, most, arity) > 1):
        tables.append(_blocks(nodes, base, arity, stride, carry))
        base += stride
        # groups that this round has brought to one node are done
        going = F.col("n") > F.lit(arity**base)
        nodes = tables[-1].where(going).select("g", "n", "at", F.col("top").alias("digest"), F.lit(None).cast("long").alias("row"))
        carry = T.LongType()
    return tables


def _ends_at(k: int, span: int) -> Column:
    """Whether a group's tree ends in the blocks of round ``k``."""
    ends = F.col("n") <= F.lit(span ** (k + 1))
    return ends & (F.col("n") > F.lit(span**k)) if k else ends


def tops(tables: list[DataFrame], span: int) -> DataFrame:
    """``(g, digest)`` of each group."""
    done = [t.where(_ends_at(k, span)).select("g", F.col("top").alias("digest")) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, done)


#: What a proof needs to know of the groups' own tree.
INFO = [("group_at", "long"), ("groups", "long"), ("subroot", "binary")]


def paths(tables: list[DataFrame], arity: int, stride: int, above: DataFrame | None = None) -> DataFrame:
    """``(g, n, at, digest, row, path binary)`` of each lowest node and the columns of ``INFO``.

    ``path`` holds the siblings from the node to its group's top, then those of
    ``above (g, path, *INFO)``, of which there is a row for each group.
    """
    info, ways = [c for c, _ in INFO], None
    for k in range(len(tables) - 1, -1, -1):
        base = stride * k
        row = tables[k].schema["rows"].dataType.elementType
        # the block that reached its group's one node goes on above the group
        ended = tables[k].where(_ends_at(k, arity**stride)).select("g", "at")
        ended = ended.join(above, "g") if above is not None else ended.withColumns({c: F.lit(None).cast(t) for c, t in [("path", "binary"), *INFO]})
        ended = ended.select("g", "at", F.col("path").alias("up"), *info)
        ways = ended if ways is None else ways.unionByName(ended)
        blocks = tables[k].select("g", "n", "at", "low", "rows").join(ways, ["g", "at"])

        def walk(batches: Iterator[pa.RecordBatch], base=base) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    one = batch.slice(r, 1)
                    n, at, up = (one.column(c)[0].as_py() for c in ("n", "at", "up"))
                    low, rows = (one.column(c).flatten() for c in ("low", "rows"))
                    block, m, first = Block(n, base, arity, stride), len(low), at * arity**stride
                    for j, digest in enumerate(low.to_pylist()):
                        block.arrive(0, first + j, digest)
                    ways = pa.array([block.siblings(first + j) + (up or b"") for j in range(m)], pa.binary())
                    same = pa.array(np.zeros(m, np.int32))
                    every = {c: one.column(c).take(same) for c in ("g", "n", *info)} | {"at": pa.array(range(first, first + m), pa.int64()), "digest": low, "row": rows, "path": ways}
                    yield pa.RecordBatch.from_pydict({c: every[c] for c in ("g", "n", "at", "digest", "row", "path", *info)})

        schema = T.StructType().add("g", "string").add("n", "long").add("at", "long").add("digest", "binary").add("row", row).add("path", "binary")
        for c, kind in INFO:
            schema = schema.add(c, kind)
        found = blocks.mapInArrow(walk, schema)
        if not k:
            return found
        ways = written(found.select("g", "at", F.col("path").alias("up"), *info), "merkle-ways")


def merkle_manifest(df: DataFrame, leaf: Column, group: str, order: str, carry: Column | None = None, arity: int = 2, stride: int | None = None) -> DataFrame:
    """A row for each row of ``df``: ``(key, row, leaf, at, n, group_at, groups, subroot, root, path)``.

    ``leaf`` is a hex digest, ``group`` a string column; ``key`` is the column ``order``, ``row`` what ``carry`` gives.
    Digests are binary; ``path`` holds the siblings from leaf to root, one after another.
    """
    stride = stride or STRIDE
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))
    own = F.struct(F.col(order).alias("key"), (F.lit(None).cast("string") if carry is None else carry).alias("carried"))
    leaves = written(df.select(key.alias("g"), F.col(order).alias("o"), F.unhex(leaf).alias("digest"), own.alias("row")), "leaves")
    trees = grow(ranked(leaves, "g", ["o", "digest"]), arity, stride)
    if not trees:  # no rows
        kinds = {f.name: f.dataType for f in leaves.schema}
        empty = [T.StructField("key", df.schema[order].dataType), T.StructField("row", kinds["row"]["carried"].dataType), T.StructField("leaf", T.BinaryType())]
        empty += [T.StructField(x, T.LongType()) for x in ("at", "n", "group_at", "groups")] + [T.StructField(x, T.BinaryType()) for x in ("subroot", "root", "path")]
        return df.sparkSession.createDataFrame([], T.StructType(empty))
    groups = tops(trees, arity**stride).select(F.lit("").alias("g"), F.col("g").alias("row"), "digest")
    over = grow(ranked(groups, "g", ["row"]), arity, stride)
    root = bytes(tops(over, arity**stride).first()["digest"])  # one digest
    above = paths(over, arity, stride).select(F.col("row").alias("g"), "path", F.col("at").alias("group_at"), F.col("n").alias("groups"), F.col("digest").alias("subroot"))
    found = paths(trees, arity, stride, written(above, "merkle-groups"))
    return found.select(F.col("row.key").alias("key"), F.col("row.carried").alias("row"), F.col("digest").alias("leaf"), "at", "n", "group_at", "groups", "subroot", F.lit(root).alias("root"), "path")


def folded(leaf: Column, at: Column, n: Column, group_at: Column, groups: Column, path: Column, arity: int = 2) -> Column:
    """The root that a leaf (binary) and the siblings of its path give: a proof's check."""

    @arrow_udf("binary")
    def fold(leaves: pa.Array, ats: pa.Array, ns: pa.Array, group_ats: pa.Array, all_groups: pa.Array, siblings: pa.Array) -> pa.Array:
        out = []
        for digest, *places, way in zip(*(x.to_pylist() for x in (leaves, ats, ns, group_ats, all_groups, siblings))):
            held = 0
            for k, size in (places[:2], places[2:]):
                while size > 1:
                    first = k // arity * arity
                    run = []
                    for j in range(first, min(first + arity, size)):
                        if j == k:
                            run.append(digest)
                        else:
                            run.append(way[held : held + 32])
                            held += 32
                    digest, k, size = hash_of(run), k // arity, -(-size // arity)
            out.append(digest)
        return pa.array(out, pa.binary())

    return fold(leaf, at, n, group_at, groups, path)
