"""SpotSigs: fingerprints from the content words that follow common words.

A text is lower-cased and everything but letters and digits becomes a blank.
Each common word (anchor) starts a chain, the next ``CHAIN`` words that are not
anchors; anchors in a row start one chain.  The distinct chains, hashed, are
the text's signatures.  A text without any anchor takes all runs of ``CHAIN``
words, one without letters or digits itself as its only chain.

``fingerprint`` holds the whole set, so it grows with the text, and ``likeness``
is the Jaccard similarity of two whole sets.  Sets whose sizes differ too much
to be alike are not compared where only pairs above a threshold count
(``spot_classes``).

Everything is a DataFrame expression; no Python runs on the executors.

Null and empty texts have no signatures and an empty fingerprint; two of these
are wholly alike.  Equal texts, and so repeated rows, have equal fingerprints and
classes; texts of any length are taken whole.  Empty tables give empty tables.
``add_fingerprint`` keeps the other columns and replaces one named like its output;
``spot_classes`` returns its own columns only, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, written

CHAIN = 2
#: Sets that may count as large, of which rows are not shuffled in the end.
LARGE_SETS = 4_096
#: Anchors: common words of English, German, French and Spanish.  Fixed values.
ANCHORS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "el los y del se las por con no una su para es al lo como más o pero sus"
).split()
#: Possessive, which the regex engine runs as a loop: rows of thousands of anchors would overflow its stack otherwise.
_SPLIT = "(?: (?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (w[0], -len(w), w))) + ")(?= ))++"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spot_hashes(text: Column) -> Column:
    """Distinct signatures of a text as a sorted ``array<long>`` of 40-bit hashes."""
    text = F.coalesce(text, F.lit(""))
    hashed = lambda s: F.shiftrightunsigned(F.xxhash64(s), 24)

    def chains(runs: Column) -> Column:
        def of(run: Column, i: Column) -> Column:
            return hashed(F.substring_index(F.concat(run, F.coalesce(F.get(runs, i + 1), F.lit(""))), " ", CHAIN + 1))

        return F.slice(F.transform(runs, of), F.lit(2), F.size(runs) - 1)

    def runs_of_words(words: Column) -> Column:
        return F.transform(words, lambda w, i: hashed(F.concat_ws(" ", w, F.get(words, i + 1))))

    def of_plain(plain: Column) -> Column:
        def of_runs(runs: Column) -> Column:
            return F.when(F.size(runs) > 1, chains(runs)).otherwise(_bound(F.split(plain, " "), runs_of_words))

        spaced = F.concat(F.lit(" "), plain, F.lit(" "))
        return F.when(plain == "", F.array(hashed(text))).otherwise(_bound(F.split(spaced, _SPLIT, -1), of_runs))

    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    found = F.when(text == "", F.array().cast("array<bigint>")).otherwise(_bound(plain, of_plain))
    return F.sort_array(F.array_distinct(found))


def fingerprint(hashes: Column) -> Column:
    """All hashes of a set as a string, ten hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two whole sets, from 0 to 1."""
    found = _bound(F.size(F.array_intersect(a, b)), lambda both: both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(found)


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """``df`` with the whole signature set of ``text``."""
    return df.withColumn(out, spot_hashes(F.col(text)))


def with_next(df: DataFrame, columns: list[str], id: str = "doc_id", tie: str = "text", rows_per_bucket: int = 500, segments: int = 64, max_buckets: int = 16_384) -> DataFrame:
    """``df`` with ``next_<column>`` of the next row by descending ``id``; after the last row comes the first.

    Rows are dealt into ranges of ``id``, evenly between quantiles of it; the
    first row of each range is also given to the range before.  Rows of equal
    id are ordered by ``tie``, null ids come last.  There are at most about
    ``max_buckets`` ranges, so what is sent to the driver and to all tasks is bounded.
    Columns named like an output, or ``_bucket``, ``_top``, ``_to``, ``_guest`` or
    ``_before``, are replaced or lost.
    """
    spark = df.sparkSession
    stats = df.agg(F.count("*").alias("n"), F.percentile_approx(id, [k / segments for k in range(segments + 1)], 10_000).alias("q")).first()
    cuts = sorted(set(stats["q"] or [0]))
    each = max(1, min(math.ceil(stats["n"] / rows_per_bucket), max_buckets) // segments)
    low, high = F.array(*[F.lit(int(c)) for c in cuts]), F.array(*[F.lit(int(c)) for c in [*cuts[1:], cuts[-1] + 1]])
    value = F.least(F.greatest(F.col(id).cast("long"), F.lit(int(cuts[0]))), F.lit(int(cuts[-1])))
    seg = F.size(F.filter(low, lambda c: c <= value))
    part = F.floor((value - F.element_at(low, seg)) * each / (F.element_at(high, seg) - F.element_at(low, seg)))
    bucket = F.coalesce((seg * each + part).cast("int"), F.lit(-1))
    placed = df.withColumn("_bucket", bucket)
    # one row for each range: its first id, and the range to which it is given too
    tops = sorted(placed.groupBy("_bucket").agg(F.max(id).alias("top")).collect(), key=lambda r: -r["_bucket"])
    rows = [(r["_bucket"], r["top"], tops[k - 1]["_bucket"]) for k, r in enumerate(tops)]
    given = spark.createDataFrame(rows, "_bucket int, _top long, _before int")
    both = (
        placed.join(F.broadcast(given), "_bucket")
        .withColumn("_top", F.col(id).eqNullSafe(F.col("_top")))
        .withColumn("_to", F.explode(F.when(F.col("_top"), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest"))))))
        .drop("_bucket", "_before", "_top")
        .select("*", F.col("_to.b").alias("_bucket"), F.col("_to.guest").alias("_guest"))
        .drop("_to")
    )
    w = Window.partitionBy("_bucket").orderBy("_guest", F.col(id).desc_nulls_last(), F.col(tie).asc_nulls_first())
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_guest = 0").drop("_bucket", "_guest")


def spot_classes(df: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_spots, class_id)``: near duplicates by their whole signature sets.

    Sets are partitioned by length so that similar sets lie in the same or the
    next partition; within these, sets are paired by their rarest signatures
    and pairs pruned by length and by place before the Jaccard similarity is taken.  The
    nodes are the distinct sets, so rows of equal or null id are compared like any other.
    ``class_id`` is the least id that links reach.
    """
    sets = df.select(F.col(id).alias("id"), spot_hashes(F.col(text)).alias("s"))
    every = written(sets.select("id", "s", F.size("s").alias("n"), F.sha2(fingerprint(F.col("s")).cast("binary"), 256).alias("key")), "spots")
    alike = every.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.first("s").alias("s"))
    numbered = alike.withColumn("node", F.monotonically_increasing_id())
    nodes = written(numbered.withColumn("p", F.floor(F.log(F.col("n") * 1.0) / math.log(100 / percent)).cast("int")), "spot-nodes")
    each = nodes.select("node", "n", "p", F.explode("s").alias("spot"))
    held = each.groupBy("spot").count().where("count > 1")
    order = Window.partitionBy("node").orderBy("count", "spot")
    ranked = each.join(held, "spot").withColumn("at", F.col("n") - F.count("*").over(Window.partitionBy("node")) + F.row_number().over(order))
    ranked = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1)
    a = ranked.select("spot", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    b = ranked.select("spot", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "p")
    fits = (F.col("a") != F.col("b")) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    enough = (100 + percent) * (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = a.join(b, ["spot", "p"]).where(fits & enough).select("a", "b").distinct()
    left, right = nodes.select(F.col("node").alias("a"), F.col("s").alias("s_a")), nodes.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    links = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")
    # written, as components reads them twice
    found = components(written(links, "spot-links")).select(F.col("id").alias("node"), "component")
    joined = written(found.join(nodes.select("node", "least"), "node"), "spot-joined")
    least = joined.groupBy("component").agg(F.min("least").alias("class_id"))
    named = joined.join(least, "component").select("node", "class_id", F.lit(True).alias("linked"))
    known = nodes.select("key", "node", "rows", "least").join(named, "node", "left")
    classes = written(known.select("key", "rows", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("least")).alias("class_id")), "spot-classes")
    # sets of over a 4,096th of the rows are sent to all tasks, so that copies are not shuffled; rows without signatures are classes of their own
    some = every.where("n > 0").select("id", "n", "key")
    large = F.broadcast(classes.where(F.col("rows") > F.lit(every.count() / LARGE_SETS)).select("key", "class_id", F.lit(True).alias("sent")))
    marked = some.join(large, "key", "left")
    rest = marked.where("sent is null").select("id", "n", "key").join(classes.select("key", "class_id"), "key")
    placed = marked.where("sent").select("id", "n", "class_id").unionByName(rest.select("id", "n", "class_id")).unionByName(every.where("n = 0").select("id", "n", F.col("id").alias("class_id")))
    return placed.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_spots"), F.coalesce("class_id", "id").alias("class_id"))
