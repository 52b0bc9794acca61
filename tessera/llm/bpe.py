"""Byte-level BPE encoding and decoding by monoid tree reduction.

The encodings of byte strings form a monoid under ``join``.  A text is halved
at run boundaries until at most ``FAN`` runs are left, a match of the pattern
is halved at bytes until at most ``LEAF`` are left; leaves are merged by rank
or looked up, and neighbours are joined up the tree.  Inside a match ``join``
re-encodes a window around the boundary and lets it grow until both its outer
edges are *stable*.  An edge between tokens a and b is stable when the bytes of
a and b together encode to exactly (a, b).  A token sequence of which every
neighbouring pair is stable is the encoding of its bytes, so once both edges are
stable no token outside the window can change.  Between matches every edge is
stable, as they never interact, so there joining is concatenation and needs no
window.  Runs are cut at blanks at which the pattern always cuts; a leaf's runs,
and matches that are vocabulary entries, are looked up in tables.

Decoding halves the ids until at most ``FAN`` are left, looks these up, and
concatenates up the tree.

Null text counts as empty and yields no ids.  Empty tables give empty tables.
Repeated rows are encoded each on its own.  Other columns pass through; an
input column with the output's name is replaced.  A worker holds the tables of
one codec, each of a bounded size, besides the batch of rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import held

#: Bytes of a match, and runs or ids of a text, that make a leaf of the tree.
LEAF, FAN = 8, 64
#: Entries after which one of a worker's tables of encoded strings starts anew.
CACHE = 300_000
#: Bits that tell whether a run was met before; runs are remembered from their second time on.
MET = 1 << 23
#: A blank that the pattern would put into one piece with the white space before it.
_GLUED = re.compile(r"\s (?:\s|\Z)")

_PLAIN = [(" ab é", [" ab", " é"]), (" ab, c", [" ab", ",", " c"]), ("a\n b\tc", ["a", "\n", " b", "\t", "c"]), (" é! 1a", [" é", "!", " 1", "a"])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeCodec:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        #: whether the pattern cuts before blanks and after letters, as the shortcuts below assume
        self.plain = all(self.pieces(x) == y for x, y in _PLAIN)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}
        self._tree: dict[bytes, tuple[int, ...]] = {}
        self._chunk: dict[str, bytes] = {}
        self._missed: dict[int, int] = {}
        self._met = bytearray(MET // 8)

    # -- leaves ---------------------------------------------------------
    def merge(self, data: bytes) -> tuple[int, ...]:
        """Rank-ordered merging of one byte string, leftmost first on ties."""
        ranks = self.ranks
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap, for wide windows."""
        n, ranks = len(data), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] != mid or j >= n or j != mid or end[j] != stop:
                continue
            end[i], after[i], end[j] = stop, after[j], -1
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heapq.heappush(heap, (r, k, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return tuple(out)

    # -- the monoid -----------------------------------------------------
    def stable(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > CACHE:
                self._stable.clear()
            known = self._stable[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == key
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``left`` followed by those of ``right``."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            cut = len(left) - i
            window = b"".join(map(self.bytes_of.__getitem__, left[cut:] + right[:j]))
            mid = self.merge(window)
            open_left = cut > 0 and not self.stable(left[cut - 1], mid[0])
            open_right = j < len(right) and not self.stable(mid[-1], right[j])
            if not open_left and not open_right:
                return left[:cut] + mid + right[j:]
            if open_left:
                i = min(2 * i, len(left))
            if open_right:
                j = min(2 * j, len(right))

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Encode halves, then join them; short strings are remembered."""
        got = self._tree.get(data)
        if got is None:
            if len(data) <= LEAF:
                got = self.merge(data)
            else:
                mid = len(data) // 2
                got = self.join(self.tree(data[:mid]), self.tree(data[mid:]))
            if len(data) <= LEAF or len(data) <= 2 * LEAF and self._again(data):
                self._keep(self._tree, data, got)
        return got

    def _keep(self, known: dict, key, got) -> None:
        """Remember up to ``CACHE`` entries; a full table starts anew after eight times as many misses."""
        if len(known) < CACHE:
            known[key] = got
            return
        self._missed[id(known)] = missed = self._missed.get(id(known), 0) + 1
        if missed > 8 * CACHE:
            known.clear()
            self._missed[id(known)] = 0

    # -- texts ----------------------------------------------------------
    def _match(self, piece: str) -> bytes:
        """Ids of one match of the pattern."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return array("i", (whole,) if whole is not None else self.tree(data)).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run of whole matches."""
        # a blank and letters are one match, and so is one mark after them
        if not self.plain:
            pieces = self.pieces(run)
        elif run[:1] == " " and run[1:].isalpha():
            pieces = (run,)
        elif run[:1] == " " and run[1:-1].isalpha() and run[-1] in ".,;:!?)":
            pieces = (run[:-1], run[-1])
        else:
            pieces = self.pieces(run)
        return concatenated(list(map(self._match, pieces)), 0, len(pieces))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text.

        Runs that start at a blank hold whole matches of the pattern, unless
        the blank stands inside white space, so they are encoded once and
        remembered; texts with such blanks are one run.
        """
        if not text:
            return np.empty(0, np.int32)
        if not self.plain or "\0" in text or _GLUED.search(text):
            return np.frombuffer(self._run(text), np.int32)
        known = self._chunk
        runs = text.replace(" ", "\0 ").split("\0")
        parts = list(map(known.get, runs))
        if None in parts:
            for at, run in enumerate(runs):
                if parts[at] is None:
                    parts[at] = got = self._run(run)
                    if len(run) <= 48 and self._again(run):
                        self._keep(known, run, got)
        return np.frombuffer(concatenated(parts, 0, len(parts)), np.int32)

    def _again(self, run: str | bytes) -> bool:
        slot = hash(run) % MET
        at, bit = slot >> 3, 1 << (slot & 7)
        met = self._met[at] & bit
        self._met[at] |= bit
        return bool(met)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids."""
        return concatenated(ids, 0, len(ids), self.bytes_of.__getitem__)


def concatenated(parts: list, lo: int, hi: int, of: Callable | None = None) -> bytes:
    """The bytes of ``parts[lo:hi]``, or of what ``of`` gives for each, concatenated up a tree."""
    if hi - lo <= FAN:
        return b"".join(map(of, parts[lo:hi]) if of else parts[lo:hi])
    mid = (lo + hi) // 2
    return concatenated(parts, lo, mid, of) + concatenated(parts, mid, hi, of)


def codec(path: str, pattern: str) -> TreeCodec:
    """The codec that this worker holds."""
    return held(("bpe", path, pattern), lambda: TreeCodec(read_ranks(path), pattern))


def gathered(parts: Iterable[bytes]) -> tuple[np.ndarray, pa.Buffer]:
    """Ends and bytes of parts one after another, without a second copy of them."""
    held, ends = bytearray(), [0]
    for part in parts:
        held += part
        ends.append(len(held))
    return np.array(ends, np.int64), pa.py_buffer(held)


def lists_of_ids(parts: Iterable[bytes]) -> pa.Array:
    """``array<int>`` of ids as little-endian int32."""
    ends, held = gathered(parts)
    values = pa.Array.from_buffers(pa.int32(), len(held) // 4, [None, held])
    return pa.ListArray.from_arrays(pa.array((ends // 4).astype(np.int32)), values)


def _encoded(own: TreeCodec, texts: pa.Array) -> pa.Array:
    return lists_of_ids(own.encode(x.as_py()).tobytes() for x in texts)


def _decoded(own: TreeCodec, lists: pa.Array) -> pa.Array:
    ends, held = gathered(own.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in lists)
    known = np.packbits(np.array(lists.is_valid()), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(lists), [pa.py_buffer(known), pa.py_buffer(ends.astype(np.int32)), held])


def encode_column(text: Column, path: str, pattern: str) -> Column:
    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _encoded(codec(path, pattern), texts)

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    @arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        return _decoded(codec(path, pattern), lists)

    return decode(ids)


def both_column(text: Column, path: str, pattern: str) -> Column:
    """``struct(ids, decoded)`` in one pass; where ``decode`` is applied to a column of ``encode``, Spark encodes twice."""

    @arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        ids = _encoded(own, texts)
        return pa.StructArray.from_arrays([ids, _decoded(own, ids)], ["ids", "decoded"])

    return both(text)


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``; null text gives an empty array."""
    return df.withColumn(out, encode_column(F.col(text), path, pattern))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each id list as ``binary``; a null list gives null, an unknown id fails."""
    return df.withColumn(out, decode_column(F.col(ids), path, pattern))


def bpe_both(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``bpe_encode``, then ``bpe_decode`` of its ids, in one pass; null text gives an empty array and no bytes."""
    both = both_column(F.col(text), path, pattern)
    return df.withColumns({ids: both["ids"], decoded: both["decoded"]})
