"""Product codes of vectors, with metric trees over the codebooks.

A component x becomes the integer floor(scale * x), and a vector is cut into
equal consecutive parts.  Each part position has a codebook; a part's code is
the nearest entry's index, by squared Euclidean distance, ties to the lower.

The nearest entry is found in a vantage-point tree: a node holds one entry and
two shells of the others, with the least and greatest distance of each from it.
By the triangle inequality no entry of a shell is nearer than ``max(d - high,
low - d)`` for a part at distance d from the node's entry.  Distances here are
roots of whole numbers, so they are rounded outwards, shells whose bound equals
the best distance are still visited, and what decides are whole squared
distances; so ties and codes are exact.  A tree takes all parts of a batch at
once, each node only those that the bound lets in.

Learning starts with the parts of the vectors with the least ids.  Each round
sends the codebooks to all tasks (``entries`` x dimension numbers) and adds up
counts and sums in each task before the shuffle, so no entry, however common,
is gathered anywhere, and the driver gets one row for each entry and component.

Rows whose vector is null or empty, holds null or non-finite components, or has
another number of components than the kept vector of the least id, are dropped.
Null ids come last in the order of ids; rows of one id go by their vectors.
Fewer rows than ``entries`` give so many entries.  Equal vectors get equal
codes.  An empty table gives an empty table and empty codebooks.  Other columns
pass through; input columns with the outputs' names are replaced.  Components
beyond what whole squared sums can hold in 64 bits (``limit``) are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import few, written

#: Entries that a leaf of the tree holds at most.
LEAF = 8
#: Values of a key above this share of the rows are few, and sent to all tasks.
HOT = 4_096


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` is an array of whole numbers, a row for each entry."""

    entries: tuple
    dims: int
    scale: int

    def text(self) -> str:
        """All components by part, entry and position, with commas between."""
        return ",".join(str(x) for part in self.entries for x in part.reshape(-1).tolist())


def limit(dims: int) -> int:
    """The greatest whole component for which sums of squared differences stay below 2^63."""
    return math.isqrt((2**63 - 1) // max(1, dims)) // 2


def whole(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of whole components."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > limit(dims):
        raise ValueError(f"components must lie within {limit(dims)} after scaling")
    return x.astype(np.int64).reshape(-1, dims)


def _root(squares: np.ndarray, to: float) -> np.ndarray:
    """Distances of whole squared distances, rounded towards ``to``."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), to).clip(0)), to)


class EntryTree:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(np.arange(len(entries)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return np.sort(ids)
        top, rest = ids[0], ids[1:]
        squares = ((self.entries[rest] - self.entries[top]) ** 2).sum(1)
        order = np.argsort(squares, kind="stable")
        shells = []
        for at in (order[: len(order) // 2], order[len(order) // 2 :]):
            low, high = _root(squares[at].min(), -np.inf), _root(squares[at].max(), np.inf)
            shells.append((max(0.0, float(low)), float(high), self._build(rest[at])))
        return int(top), shells

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry."""
        best = np.full(len(parts), len(self.entries), np.int64)
        least = np.full(len(parts), np.iinfo(np.int64).max, np.int64)
        self._visit(self.root, parts, np.arange(len(parts)), best, least)
        return best, least

    def _take(self, rows, ids, squares, best, least) -> None:
        better = (squares < least[rows]) | (squares == least[rows]) & (ids < best[rows])
        at = rows[better]
        best[at], least[at] = (ids[better] if isinstance(ids, np.ndarray) else ids), squares[better]

    def _visit(self, node, parts, rows, best, least) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            squares = ((parts[rows, None, :] - self.entries[node][None, :, :]) ** 2).sum(2)
            at = squares.argmin(1)  # the first of equal ones, so the lower index
            self._take(rows, node[at], squares[np.arange(len(rows)), at], best, least)
            return
        top, shells = node
        squares = ((parts[rows] - self.entries[top]) ** 2).sum(1)
        self._take(rows, np.full(len(rows), top), squares, best, least)
        low, high = _root(squares, -np.inf), _root(squares, np.inf)
        inside = high <= shells[0][1]
        for side in (True, False):  # the shell in which a part lies comes first
            held = inside == side
            own, own_low, own_high = rows[held], low[held], high[held]
            for near, far, child in shells if side else shells[::-1]:
                bound = np.nextafter(np.maximum(own_low - far, near - own_high), -np.inf)
                self._visit(child, parts, own[bound <= _root(least[own], np.inf)], best, least)


def kept(df: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector is whole: finite components, and ``dims`` of them where that is given."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector).cast("array<double>")
    some = F.size(v) == dims if dims else F.size(v) > 0
    return df.where(F.col(vector).isNotNull() & some & F.forall(v, sound))


def _nearest(codebooks: Codebooks, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row for each vector) and squared distances summed over parts."""
    width = codebooks.dims // len(codebooks.entries)
    found = [EntryTree(e).nearest(rows[:, k * width : (k + 1) * width]) for k, e in enumerate(codebooks.entries)]
    return np.stack([x for x, _ in found], 1), sum(x for _, x in found)


def learn_codebooks(df: DataFrame, id: str, vector: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of all kept rows of ``df``."""
    every = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    order = [F.asc_nulls_last("id"), F.col("v")]
    first = kept(every, "v").orderBy(*order).limit(entries).collect()
    if not first:
        return Codebooks(tuple(np.empty((0, 0), np.int64) for _ in range(parts)), 0, scale)
    dims = len(first[0].v)
    if dims % parts:
        raise ValueError(f"{dims} components are not {parts} equal parts")
    rows = kept(every, "v", dims).select("v")
    if any(len(r.v) != dims for r in first):
        first = kept(every, "v", dims).orderBy(*order).limit(entries).collect()
    start = whole(pa.array([r.v for r in first], pa.list_(pa.float64())), dims, scale)
    width = dims // parts
    books = Codebooks(tuple(start[:, k * width : (k + 1) * width].copy() for k in range(parts)), dims, scale)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floored mean of the parts that are nearest to it; unused ones stay."""
    k, width, size = len(books.entries), books.dims // len(books.entries), len(books.entries[0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(e) for e in books.entries]
        counts, totals = np.zeros((k, size), np.int64), np.zeros((k, size, width), np.int64)
        for batch in batches:
            x = whole(batch.column(0), books.dims, books.scale)
            for p, tree in enumerate(trees):
                own = x[:, p * width : (p + 1) * width]
                codes, _ = tree.nearest(own)
                np.add.at(counts[p], codes, 1)
                np.add.at(totals[p], codes, own)
        part, entry = np.nonzero(counts)
        # whole sums of a task fit in 64 bits; those of all tasks are added as decimals
        n = np.repeat(counts[part, entry], width)
        at = np.tile(np.arange(width), len(part))
        columns = [np.repeat(part, width), np.repeat(entry, width), at, n, totals[part, entry].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "n", "total"])

    sums = rows.mapInArrow(add_up, "part long, entry long, at long, n long, total long")
    sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    moved = [e.copy() for e in books.entries]
    for r in sums.collect():  # one row for each entry and component
        moved[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(tuple(moved), books.dims, books.scale)


def code_column(vector: Column, books: Codebooks) -> Column:
    """``struct(codes array<int>, error long)`` of whole vectors."""

    @arrow_udf("struct<codes:array<int>,error:long>")
    def code(vectors: pa.Array) -> pa.Array:
        codes, error = _nearest(books, whole(vectors, books.dims, books.scale))
        ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1).astype(np.int32))), pa.array(error)], ["codes", "error"])

    return code(vector.cast("array<double>"))


def assign_codes(df: DataFrame, books: Codebooks, vector: str) -> DataFrame:
    """Kept rows of ``df`` with ``codes array<int>``, ``code string`` (two hex digits a part) and ``error long``."""
    if not books.dims:
        return df.limit(0).withColumns({"codes": F.lit(None).cast("array<int>"), "code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
    coded = kept(df, vector, books.dims).withColumn("codes", code_column(F.col(vector), books))
    hexed = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return coded.withColumns({"error": F.col("codes.error"), "codes": F.col("codes.codes")}).withColumn("code", hexed)


def decode_codes(df: DataFrame, books: Codebooks, codes: str = "codes", out: str = "decoded") -> DataFrame:
    """``df`` with the vectors that ``codes`` stand for: the middle of each whole component, scaled back."""

    @arrow_udf("array<double>")
    def decode(lists: pa.Array) -> pa.Array:
        rows = [np.concatenate([e[c] for e, c in zip(books.entries, x)]) if x is not None else None for x in lists.to_pylist()]
        return pa.array([None if r is None else ((r + 0.5) / books.scale).tolist() for r in rows], pa.list_(pa.float64()))

    return df.withColumn(out, decode(F.col(codes)))


def with_key_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df``, a written table, with the sum of ``value`` over the rows of the same ``key``, nulls together.

    Sums are sent to all tasks where they are few; else those of hot keys are,
    of which there are at most ``HOT``, and only the other rows are shuffled.
    """
    sums = written(df.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias(out), F.count("*").alias("_n")), "key-totals")
    sent = few(sums)
    same = F.col(key).eqNullSafe(F.col("_k"))
    if sent is not sums:
        return df.join(sent, same).drop("_k", "_n")
    hot = F.broadcast(sums.where(F.col("_n") > F.lit(df.count() / HOT)))
    marked = df.join(hot, same, "left")
    rest = marked.where("_n is null").drop("_k", "_n", out).join(sums, same)
    return marked.where("_n is not null").drop("_k", "_n").unionByName(rest.drop("_k", "_n"))
