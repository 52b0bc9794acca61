"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the distinct shingles of ``words`` words (lower-cased
A-Z, split at ASCII white space), as 64-bit hashes.  Its signature has 60
symbols of 14 bits, each the minimum of the set under one hash function, in
12 chunks of five.  By the pigeonhole principle two signatures that differ in
at most 23 symbols agree in some chunk but for one symbol.  All chunk errors
allowed are enumerated: a document has a key for each chunk and each symbol
left out, 60 keys in all, so every pair within that distance shares a key.
Pairs beyond it are found as well when they share a key; at a similarity of
0.8 a pair goes unseen with a probability of about one in ten million.

Steps, each of them distributed:

1. signatures; sets that are wholly alike are one node from here on;
2. keys with more than one node; each node is paired with the least node of each
   of its keys, so a group of n copies gives O(n) pairs;
3. pairs that sizes, parities of the sets' parts and signature distance don't
   exclude are confirmed on the full sets, and components found;
4. nodes of keys that still hold different components are paired with one more
   node of each of up to ``LEADERS`` of their keys, and confirmed pairs join components;
5. of keys that hold different components even then, all pairs across them are
   confirmed, so no link that would join two components is missed.  Small keys
   form these pairs themselves; the nodes of large ones are paired by the rare
   shingles of their full sets, which finds every pair that can link without
   forming those that only share a common passage;
6. components of all links.

No bucket is capped.  Joins are plain equi-joins, which adaptive execution can
split where a key is hot.  Intermediate tables are written to the shared folder.

Null or empty texts, and texts without words, have an empty set and no links;
a text of fewer words than a shingle is one shingle.  Long texts are taken whole.
Nodes are distinct sets, so each text of an id that has several is compared,
and rows of one id are linked.  Rows without an id are nodes as all others; their
component is the least id that their set reaches, null if it reaches none.  An empty table gives an empty table.  Only the two named
columns are read, so others may have any name; they are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import components, few, held, written

CHUNKS, WIDTH = 12, 5
SYMBOLS = CHUNKS * WIDTH
BITS = 14
LANES = SYMBOLS // 4
#: Longs after a signature's lanes that hold, for each of 512 parts of the hashes, whether a set has an odd number in it.
ODDS = 8
#: Symbols in which two signatures may differ for the pair to be confirmed on full
#: sets.  At a similarity of 0.8 the mean is 12 and the standard deviation 3.1.
MAX_DISTANCE = 33
#: Keys by which a node of unsettled keys is paired with one more node in the second round.
LEADERS = 8
#: Nodes up to which all pairs of a key across components are formed; beyond, the
#: prefixes of the full sets give the pairs.
SMALL_KEY = 32
#: Sets that may count as large, of which rows are not shuffled in the end.
LARGE_SETS = 4_096

_ONE = (1 << BITS) - 1
_FILL = sum(_ONE << (16 * k) for k in range(4))
_GUARD = sum(1 << (16 * k + BITS) for k in range(4))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles."""
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces only
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)
    k = min(words, n)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[j : n - k + 1 + j]
    out = _mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def symbols(shingles: np.ndarray) -> np.ndarray:
    """The signature: 60 symbols of 14 bits."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(SYMBOLS, np.uint32)
    for k in range(SYMBOLS):
        out[k] = (h * _A[k] + _B[k]).min()
    return _mixed(out.astype(np.uint64)) & np.uint64(_ONE)


def lanes_and_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures (one in each row): four symbols in a long, and the keys."""
    four = sig.reshape(len(sig), LANES, 4)
    lanes = four[:, :, 0] | four[:, :, 1] << np.uint64(16) | four[:, :, 2] << np.uint64(32) | four[:, :, 3] << np.uint64(48)
    chunks = sig.reshape(len(sig), CHUNKS, WIDTH)
    keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        held = [j for j in range(WIDTH) if j != out]
        key = np.zeros((len(sig), CHUNKS), np.uint64)
        for j in held:
            key = key << np.uint64(BITS) | chunks[:, :, j]
        salt = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out + 1)) * _MIX
        keys[:, :, out] = _mixed(key ^ salt)
    return lanes.view(np.int64), keys.reshape(len(sig), SYMBOLS).view(np.int64)


def odds(shingles: np.ndarray) -> np.ndarray:
    """Bits that tell in which parts of the hashes a set has an odd number."""
    counts = np.bincount((shingles & np.uint64(64 * ODDS - 1)).astype(np.int64), minlength=64 * ODDS)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _longs(rows: np.ndarray, has: np.ndarray, width: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def signature(text: Column, words: int) -> Column:
    """``struct(n, high, low, lanes, keys)`` of whole texts."""

    @arrow_udf("struct<n:long,high:long,low:long,lanes:array<long>,keys:array<long>>")
    def compute(texts: pa.Array) -> pa.Array:
        held("minhash", object)  # frees what an earlier step has left
        n, high, low, sigs, bits = [], [], [], [], []
        for x in texts:
            s = shingle_set(x.as_py(), words)
            whole = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            high.append((whole >> 64) - (1 << 63))
            low.append((whole & (2**64 - 1)) - (1 << 63))
            if len(s):
                sigs.append(symbols(s))
                bits.append(odds(s))
        lanes, keys = lanes_and_keys(np.array(sigs, np.uint64).reshape(-1, SYMBOLS))
        lanes = np.hstack([lanes, np.array(bits, np.int64).reshape(-1, ODDS)])
        has = np.array(n, np.int64) > 0
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _longs(lanes, has, LANES + ODDS), _longs(keys, has, SYMBOLS)],
            ["n", "high", "low", "lanes", "keys"],
        )

    return compute(text)


def distance(a: str, b: str) -> Column:
    """Symbols in which the lanes ``a`` and ``b`` differ."""
    return sum(
        (F.bit_count((F.col(a)[k].bitwiseXOR(F.col(b)[k]) + F.lit(_FILL)).bitwiseAND(F.lit(_GUARD))) for k in range(1, LANES)),
        F.bit_count((F.col(a)[0].bitwiseXOR(F.col(b)[0]) + F.lit(_FILL)).bitwiseAND(F.lit(_GUARD))),
    )


def may_link(a: str, b: str, n_a: str, n_b: str, percent: int) -> Column:
    """False only for pairs of sets that cannot reach the similarity, by sizes and bits of the lanes ``a`` and ``b``.

    Each bit in which they differ needs an element that only one of them has,
    and linked sets have at most ``(100 - percent) / (100 + percent)`` of their elements' number of those.
    """
    bits = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(LANES, LANES + ODDS)), F.lit(0))
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & ((100 + percent) * bits <= (100 - percent) * (F.col(n_a) + F.col(n_b)))


def linked(a: Column, b: Column, words: int, percent: int) -> Column:
    """Whether ``100 * intersection >= percent * union`` holds for the full sets of two texts."""

    @arrow_udf("boolean")
    def compute(left: pa.Array, right: pa.Array) -> pa.Array:
        sets: dict[str, np.ndarray] = {}
        size = 0

        def of(text: str) -> np.ndarray:
            nonlocal size
            got = sets.get(text)
            if got is None:
                got = shingle_set(text, words)
                if size > 4_000_000:
                    sets.clear()
                    size = 0
                sets[text] = got
                size += len(got)
            return got

        out = []
        for x, y in zip(left, right):
            p, q = of(x.as_py()), of(y.as_py())
            if len(p) > len(q):
                p, q = q, p
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            both = int((q[at] == p).sum())
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return compute(a, b)


def hashes(text: Column, words: int) -> Column:
    """The full set as ``array<long>``."""

    @arrow_udf("array<long>")
    def compute(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(x.as_py(), words).view(np.int64) for x in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))

    return compute(text)


def prefix_pairs(sets: DataFrame, lanes: DataFrame, fits: Column, percent: int, max_distance: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets (id, c, n, s)`` that may reach the similarity; none that does is missing.

    Only pairs of different components ``c`` count.  With every set ordered by how
    few sets hold a shingle, two sets that reach it share one of their first ``n - ceil(percent n / 100) + 1``; and at the
    first one that they share enough shingles must be left in both.  Pairs that
    the signatures' distance excludes go within the join, so few rows leave it.
    """
    each = sets.select("id", "c", "n", F.explode("s").alias("s"))
    # shingles of one component only come first in the order: no pair across components has them
    held = each.groupBy("s").agg(F.count("*").alias("count"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s", "count")
    order = Window.partitionBy("id").orderBy("count", "s")
    several = Window.partitionBy("id")
    ranked = each.join(held, "s").withColumn("at", F.col("n") - F.count("*").over(several) + F.row_number().over(order))
    ranked = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1)
    ranked = ranked.join(lanes.select("id", "lanes"), "id")
    sides = [
        ranked.select("s", F.col("id").alias(x), F.col("c").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"), F.col("lanes").alias(f"l_{x}"))
        for x in "ab"
    ]
    near = distance("l_a", "l_b") <= max_distance
    enough = (100 + percent) * (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))) >= percent * (F.col("n_a") + F.col("n_b"))
    return sides[0].join(sides[1], "s").where(fits & enough & near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row for each row of ``df``: ``(id, n_shingles, component_id)``.

    ``component_id`` is the least id that can be reached by links.  Pairs whose
    signatures differ in more than ``max_distance`` symbols are not confirmed;
    at 60 every pair that shares a key is.
    """
    # t tells the texts of one id apart
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text")).withColumn("t", F.xxhash64("text"))
    sig = written(docs.select("id", "t", signature(F.col("text"), words).alias("s")).select("id", "t", "s.*"), "signatures")
    some = sig.where("n > 0")
    sets = some.groupBy("high", "low").agg(
        F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "t"))), F.min(F.struct("id", "t"))).alias("top"), F.count("*").alias("rows"), F.first(F.struct("n", "lanes", "keys")).alias("s")
    )
    # a set is known by its number; its least id, if any row has one, names it once links are found
    reps = written(
        sets.select(F.monotonically_increasing_id().alias("id"), F.col("top.id").alias("doc"), "top.t", "high", "low", "rows", "s.*"), "nodes"
    )
    keyed = reps.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key", "low")
    members = written(keyed.join(shared, "key"), "members", SYMBOLS * reps.count())
    met = members.count()

    lanes = reps.select("id", "n", "lanes")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and signatures don't exclude."""
        a = lanes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("lanes").alias("l_a"))
        b = lanes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("lanes").alias("l_b"))
        return pairs.join(a, "a").join(b, "b").where(may_link("l_a", "l_b", "n_a", "n_b", percent) & (distance("l_a", "l_b") <= max_distance)).select("a", "b")

    stars = members.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    stars = written(close(stars), "stars", met)

    needed = few(written(members.select("id").distinct().join(reps.select("id", "doc", "t"), "id"), "needed", met))
    found_texts = docs.select(F.col("id").alias("own"), F.col("t").alias("own_t"), "text").join(needed, F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_t") == F.col("t"))).select("id", "text")
    texts = written(found_texts.groupBy("id").agg(F.first("text").alias("text")), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))
        return pairs.join(left, "a").join(right, "b").where(linked(F.col("t_a"), F.col("t_b"), words, percent)).select("a", "b")

    links = written(confirmed(stars), "links", stars.count())
    tried = stars
    found = components(links)

    def unsettled(found: DataFrame) -> DataFrame:
        """``(key, id, c, m)``: the nodes, and their number, of keys whose nodes lie in different components."""
        placed = members.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        placed = written(placed, "placed", met)
        split = placed.groupBy("key").agg(F.min("c").alias("c_low"), F.max("c").alias("c_high"), F.count("*").alias("m"))
        return placed.join(split.where("c_low <> c_high").select("key", "m"), "key")

    # some other node of each of a few keys, so that groups whose ends don't link come together
    open_keys = written(unsettled(found), "open", met)
    leaders = open_keys.groupBy("key").agg(F.min_by(F.struct("id", "c"), F.xxhash64("id", "key")).alias("top"))
    some_keys = Window.partitionBy("id").orderBy(F.xxhash64("key"))
    more = (
        open_keys.join(leaders, "key")
        .where("c <> top.c")
        .withColumn("k", F.row_number().over(some_keys))
        .where(F.col("k") <= LEADERS)
        .select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b"))
        .distinct()
    )
    more = written(close(more.join(tried, ["a", "b"], "left_anti")), "more", met)
    tried = tried.unionByName(more)
    links = written(links.unionByName(confirmed(more)), "links", links.count() + more.count())
    open_keys = written(unsettled(components(links)), "open", met)

    # all pairs across components that can still link
    fits = (F.col("c_a") < F.col("c_b")) & may_link("l_a", "l_b", "n_a", "n_b", percent)
    small = open_keys.where(F.col("m") <= SMALL_KEY).join(lanes, "id")
    left = small.select("key", F.col("id").alias("a"), F.col("c").alias("c_a"), F.col("n").alias("n_a"), F.col("lanes").alias("l_a"))
    right = small.select("key", F.col("id").alias("b"), F.col("c").alias("c_b"), F.col("n").alias("n_b"), F.col("lanes").alias("l_b"))
    rest = left.join(right, "key").where(fits & (distance("l_a", "l_b") <= max_distance)).select("a", "b")
    large = open_keys.where(F.col("m") > SMALL_KEY).select("id", "c").distinct()
    sets = texts.join(large, "id").select("id", "c", hashes(F.col("text"), words).alias("s")).withColumn("n", F.size("s"))
    rest = rest.unionByName(prefix_pairs(written(sets, "sets"), lanes, fits, percent, max_distance))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest", met)
    links = written(links.unionByName(confirmed(rest)), "links", links.count() + rest.count())
    # the sets of one id are linked too
    rows = some.where("id is not null").select(F.col("id").alias("doc"), "high", "low")
    several = rows.groupBy("doc").agg(F.min(F.struct("high", "low")).alias("x"), F.max(F.struct("high", "low")).alias("y")).where("x <> y").select("doc")
    of = written(rows.join(several, "doc").distinct().join(reps.select("id", "high", "low"), ["high", "low"]).select("doc", "id"), "sets-of-id", sig.count())
    same = of.join(of.groupBy("doc").agg(F.min("id").alias("a")), "doc").where("a <> id").select("a", F.col("id").alias("b"))
    joined = written(components(written(links.unionByName(same), "set-links", links.count())).join(reps.select("id", "doc"), "id"), "joined", met)
    least = joined.groupBy("component").agg(F.min("doc").alias("least"))
    named = joined.join(least, "component").select("id", "least", F.lit(True).alias("linked"))
    known = reps.select("id", "high", "low", "rows", "doc").join(named, "id", "left")
    known = written(known.select("high", "low", "rows", F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc")).alias("component")), "classes", reps.count())
    # sets of over a 4,096th of the rows: at most 4,096, so they are sent to all tasks and their rows stay where they are
    large = F.broadcast(known.where(F.col("rows") > F.lit(sig.count() / LARGE_SETS)).select("high", "low", "component", F.lit(True).alias("sent")))
    marked = some.select("id", "n", "high", "low").join(large, ["high", "low"], "left")
    hot = marked.where("sent").select("id", "n", "component")
    rest = marked.where("sent is null").drop("component").join(known.select("high", "low", "component"), ["high", "low"], "left")
    every = hot.unionByName(rest.select("id", "n", "component")).unionByName(sig.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return every.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
