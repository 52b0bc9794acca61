"""Benchmark decontamination by Wu-Manber multi-pattern search.

Symbols are words: A-Z lower-cased, split at ASCII characters other than
letters and digits.  The patterns are all windows of ``size`` consecutive words
of each benchmark item; an item of fewer words is one window.  Windows of one
length m are searched together.  A table of blocks of two words gives how far
the search may shift when a text's block stands at the end of the current
place (m - 1 for blocks in no pattern); where the shift is none, the patterns
that end in this block stand in a bucket by the hash of their suffix, and each of them is
compared with the text word by word.

The benchmark's tables are broadcast in parts of at most ``part_words`` words
of patterns (or one item).  Documents are searched for one part after the
other; between parts they are written to the shared folder, so a worker holds
one part's tables whatever the benchmark's size.

Null texts have no words; items without words are ignored; repeated items count
once for each distinct id.  Items whose id is null are searched too where
``unnamed`` is set, and are one null id, last in the list; otherwise they are
ignored.  Ties don't arise; repeated documents are searched each, long ones
whole.  An empty table gives an empty table, an empty benchmark no hits.  Other columns of the documents pass through; those named
like an output are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import held, written

#: A-Z to a-z; ASCII other than letters and digits to blanks; the rest stays.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Search for windows of items in lists of words."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], size: int):
        self.number: dict[bytes, int] = {}
        number = self.number
        owners: dict[tuple[int, ...], list] = {}
        for item, words in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            m = min(size, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                owners.setdefault(tuple(ids[i : i + m]), []).append(item)
        self.base = len(number) + 1
        self.groups = []
        for m in sorted({len(p) for p in owners}):
            mine = {p: in_order(v) for p, v in owners.items() if len(p) == m}
            block = min(2, m)
            shift: dict[int, int] = {}
            buckets: dict[int, list[tuple[tuple[int, ...], list]]] = {}
            for pattern, who in mine.items():
                for end in range(block, m + 1):
                    key = self._block(pattern, end, block)
                    shift[key] = min(shift.get(key, m), m - end)
                buckets.setdefault(self._block(pattern, m, block), []).append((pattern, who))
            # within a bucket a second hash, of the whole suffix, leaves few patterns to compare
            tables = {k: self._by_suffix(v) for k, v in buckets.items()}
            self.groups.append((m, block, shift, tables))

    def _block(self, ids, end: int, block: int) -> int:
        return ids[end - 1] if block == 1 else ids[end - 2] * self.base + ids[end - 1]

    @staticmethod
    def _by_suffix(patterns: list) -> dict[int, list]:
        out: dict[int, list] = {}
        for pattern, who in patterns:
            out.setdefault(hash(pattern[-4:]), []).append((pattern, who))
        return out

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (start, end) of occurrences, and the items they belong to."""
        get = self.number.get
        ids = [get(w, 0) for w in words]
        spans: list[tuple[int, int]] = []
        found: set = set()
        n, base = len(ids), self.base
        for m, block, shift, tables in self.groups:
            end, most, jump = m, m - block + 1, shift.get
            while end <= n:
                key = ids[end - 1] if block == 1 else ids[end - 2] * base + ids[end - 1]
                step = jump(key, most)
                if step:
                    end += step
                    continue
                at = tuple(ids[end - m : end])
                for pattern, who in tables[key].get(hash(at[-4:]), ()):
                    if pattern == at:
                        spans.append((end - m, end))
                        found.update(who)
                end += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of overlapping or touching spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def in_order(items: Iterable[str | None]) -> list[str | None]:
    """Distinct ids as sorted strings, null last."""
    return sorted(set(items), key=lambda x: (x is None, x or ""))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_words: int = 2_000_000,
    unnamed: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words long, hit_spans array<struct<start,end>>, items array<string>``.

    Spans count words, from 0, end exclusive, and are merged; ``items`` are
    sorted as strings, null last.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "hit_spans", "items").withColumns(
        {"n_words": F.lit(None).cast("long"), "hit_spans": F.lit(None).cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")}
    )
    named = benchmark if unnamed else benchmark.where(F.col(item_id).isNotNull())
    rows = named.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator()

    def parts() -> Iterator[list]:
        part, n = [], 0
        for item, body in rows:
            words = words_of(body)
            if n >= part_words and words:
                yield part
                part, n = [], 0
            if words:
                part.append((item, words))
                n += size * max(1, len(words) - size + 1)
        yield part

    for k, part in enumerate(parts()):
        out = _search_part(written(out, "searched") if k else out, spark.sparkContext.broadcast((part, size)), text)
    return out


def _search_part(docs: DataFrame, shared, text: str) -> DataFrame:
    name = uuid.uuid4().hex
    kind = "struct<n_words:long,hit_spans:array<struct<start:int,end:int>>,items:array<string>>"

    @arrow_udf(kind)
    def search(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        table = held(("benchmark", name), lambda: WuManber(*shared.value))
        n, all_spans, all_items = [], [], []
        for x, old, who in zip(texts, spans, items):
            words = words_of(x.as_py())
            got, found = table.search(words)
            before = [(s["start"], s["end"]) for s in old.as_py() or ()]
            n.append(len(words))
            all_spans.append([{"start": a, "end": b} for a, b in merged(got + before)])
            all_items.append(in_order(found.union(who.as_py())))
        struct = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(all_spans, pa.list_(struct)), pa.array(all_items, pa.list_(pa.string()))],
            ["n_words", "hit_spans", "items"],
        )

    return docs.withColumn("_s", search(F.col(text), F.col("hit_spans"), F.col("items"))).drop("n_words", "hit_spans", "items").select("*", "_s.*").drop("_s")
