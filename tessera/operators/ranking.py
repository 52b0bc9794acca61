"""Passages, lexical and dense ranking, fusion, overlap suppression and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.text import bound, lines, tokens
from tessera.operators import lexical
from tessera.session import cut


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 1500, overlap: int = 4, inclusive: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, start, end, passage_id, text)``: whole lines packed greedily up to ``size`` characters.

    A longer line is a passage of its own.  Each passage begins ``overlap``
    lines early.  ``inclusive`` leaves the line break out of the length of the
    line that is tried.  Lines are numbered from 1.  Rows with a null or empty
    text have no passage.
    """
    extra = 0 if inclusive else 1

    def step(state: Column, x: Column) -> Column:
        full = (state["size"] + F.length(x) + extra > size) & (state["n"] >= state["first"])
        return F.struct(
            F.when(full, F.length(x) + 1).otherwise(state["size"] + F.length(x) + 1).alias("size"),
            F.when(full, state["n"] + 1).otherwise(state["first"]).alias("first"),
            (state["n"] + 1).alias("n"),
            F.when(full, F.concat(state["ends"], F.array(state["n"]))).otherwise(state["ends"]).alias("ends"),
        )

    start = F.struct(F.lit(0).alias("size"), F.lit(1).alias("first"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))
    packed = (
        docs.where(F.length(text) > 0)
        .select(F.col(id), *keep, lines(F.col(text)).alias("l"))
        .withColumn("ends", F.aggregate("l", start, step, lambda s: F.concat(s["ends"], F.array(s["n"]))))
    )

    def unit(end: Column, k: Column) -> Column:
        first = F.when(k == 0, F.lit(1)).otherwise(F.get("ends", k - 1) + 1)
        return bound(
            F.greatest(F.lit(1), first - overlap),
            lambda start: F.struct(start.alias("start"), end.alias("end"), F.array_join(F.slice("l", start, end - start + 1), "\n").alias("text")),
        )

    # the lines stay out of the exploded rows, which hold one passage each
    each = packed.select(id, *keep, F.explode(F.transform("ends", unit)).alias("p"))
    named = F.substring(F.sha2(F.concat_ws(":", F.col(id).cast("string"), "p.start", "p.end"), 256), 1, 24)
    return each.select(id, *keep, "p.start", "p.end", named.alias("passage_id"), "p.text")


#: Terms of queries that are sent to all tasks.
BROADCAST_TERMS = 1_000_000


def postings(units: DataFrame, terms: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, length, term, *keep, tf)``: how often each unit has each of ``terms``; each unit has the empty term once, and only its row holds ``keep``."""
    each = units.select(key, *keep, tokens(F.col(text)).alias("t")).select(key, *keep, F.size("t").alias("length"), F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
    held = [F.when(F.col("term") == "", F.col(c)).alias(c) for c in keep]
    return each.join(terms, "term", "left_semi").groupBy(key, "length", "term", *held).agg(F.count("*").alias("tf"))


def bm25(
    units: DataFrame, queries: DataFrame, key: str, query: str, limit: int = 64, text: str = "text", query_text: str = "text", k1: float = 1.2, b: float = 0.75, keep: tuple[str, ...] = (), work: Observation | None = None
) -> DataFrame:
    """``(query, key, *keep, score, rank)``: the ``limit`` best units of each query.

    A query term counts twice at most; ties go to the least ``key``; ``keep``
    names columns that ``key`` determines.  The queries' terms, if they are at
    most ``BROADCAST_TERMS``, are sent to all tasks; a unit's postings of them
    are one row, written once, so each text is tokenised once, and each task
    passes on its own best units of each query, so neither postings nor pairs
    of query and unit are shuffled.  Beyond that many terms, or if a ``key``
    occurs twice, both are.  ``work`` observes the postings visited.
    """
    asked = queries.select(query, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.least(F.count("*"), F.lit(2)).alias("qf"))
    held = asked.limit(BROADCAST_TERMS + 1).toArrow()
    if held.num_rows > BROADCAST_TERMS:
        return _shuffled_bm25(units, asked, key, query, limit, text, k1, b, keep, work)
    terms, asking = lexical.by_term(held, query, "term", "qf")
    counted = cut(lexical.postings(units, terms, np.diff(asking[1]), key, text, keep), "postings")
    if counted.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return _shuffled_bm25(units, asked, key, query, limit, text, k1, b, keep, work)
    n_units, mean_length = counted.agg(F.count("*"), F.greatest(F.lit(1.0), F.avg("length"))).first()
    each = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(terms))
    df[each.column("id").to_numpy()] = each.column("df").to_numpy()
    idf = units.sparkSession.sparkContext.broadcast(np.log(1 + (n_units - df + 0.5) / (df + 0.5)))

    def weigh(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (row, term), tf, length = lexical.lists(batch, "ids"), lexical.lists(batch, "tfs")[1], batch.column(batch.schema.get_field_index("length")).to_numpy()
        return row, term, idf.value[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean_length))

    if work is not None:
        counted = counted.observe(work, F.coalesce(F.sum("visits"), F.lit(0)).alias("bm25_posting_visits"))
    fields = {f.name: f for f in counted.schema.fields} | {query: queries.schema[query]}
    scored = lexical.ranked(counted.drop("visits"), weigh, asking, fields[key], fields[query], [fields[c] for c in keep], limit)
    return top(scored, [query], [F.desc("score"), F.asc(key)], limit)


def _shuffled_bm25(units: DataFrame, asked: DataFrame, key: str, query: str, limit: int, text: str, k1: float, b: float, keep: tuple[str, ...], work: Observation | None) -> DataFrame:
    """As ``bm25`` for any number of ``(query, term, qf)``: postings are shuffled by unit and term, and scores by query and unit.

    An empty term, once for each unit, carries the units' number, lengths and
    ``keep``; it takes part in no join.
    """
    asked = cut(asked, "asked")
    sent = F.broadcast if asked.count() <= BROADCAST_TERMS else (lambda x: x)
    unit = F.col("term") == ""
    terms = asked.select("term").unionByName(units.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counted = cut(postings(units, sent(terms), key, text, keep), "postings")
    totals = counted.where(unit).agg(F.count("*").alias("n_units"), F.greatest(F.lit(1.0), F.avg("length")).alias("mean_length"))
    df = counted.where(~unit).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length"))) * F.col("qf")
    visited = counted.where(~unit).select(key, "length", "term", "tf").join(sent(df), "term").join(sent(asked), "term")
    if work is not None:
        visited = visited.observe(work, F.count(F.lit(1)).alias("bm25_posting_visits"))
    scored = (
        visited.join(F.broadcast(totals))  # one row
        .groupBy(query, key)
        .agg(F.round(F.sum(weight), 6).alias("score"))
        .where("score > 0")
    )
    best = top(scored, [query], [F.desc("score"), F.asc(key)], limit)
    if not keep:
        return best
    return best.join(counted.where(unit).select(key, *keep), key).select(query, key, *keep, "score", "rank")


def plan_text(question: Column, translation: Column, needs: Column) -> Column:
    """What is searched for a question with a plan: it, its translation, and the plan's needs, a line each."""
    return F.concat_ws("\n", question, F.coalesce(translation, F.lit("")), F.coalesce(needs, F.array().cast("array<string>")))


def literal_hits(units: DataFrame, queries: DataFrame, key: str, query: str, limit: int = 64, text: str = "text", query_text: str = "text", path: str | None = None) -> DataFrame:
    """``(query, key, score, rank)``: 4 for each literal of a query that the unit's ``path`` holds, 1 for each other that its text does.

    Literals are names with the dots, slashes and hyphens in them, counted as
    often as the query has them; in a text they stand between characters of
    no word.  As in ``bm25``, at most ``BROADCAST_TERMS`` of them are sent to
    all tasks, and tasks pass on their own best units of each query; beyond
    that many, or if a ``key`` occurs twice, finds and pairs are shuffled.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(query_text), F.lit("")), F.lit(r"[A-Za-z_][A-Za-z_0-9./-]*"), F.lit(0))
    asked = queries.select(query, F.explode(found).alias("literal")).groupBy(query, "literal").agg(F.count("*").alias("n"))
    held = asked.limit(BROADCAST_TERMS + 1).toArrow()
    if held.num_rows > BROADCAST_TERMS:
        return _shuffled_literals(units, asked, key, query, limit, text, path)
    literals, asking = lexical.by_term(held, query, "literal", "n")
    letters = F.regexp_replace(F.regexp_replace(text, r"(?U)[\w&&[^\x00-\x7f]]", lexical.LETTER), rf"[^\x00-\x7f{lexical.LETTER}]", " ")
    plain = units.withColumn("_t", F.when(F.octet_length(text) == F.length(text), F.col(text)).otherwise(letters))
    found = cut(lexical.literal_postings(plain, literals, key, "_t", path), "finds")
    if found.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return _shuffled_literals(units, asked, key, query, limit, text, path)

    def weigh(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *lexical.lists(batch, "ids"), lexical.lists(batch, "weights")[1].astype(float)

    scored = lexical.ranked(found, weigh, asking, found.schema[key], queries.schema[query], [], limit).withColumn("score", F.col("score").cast("long"))
    return top(scored, [query], [F.desc("score"), F.asc(key)], limit)


def _shuffled_literals(units: DataFrame, asked: DataFrame, key: str, query: str, limit: int, text: str, path: str | None) -> DataFrame:
    """As ``literal_hits`` for any number of ``(query, literal, n)``.

    A literal's first word is a whole word of such a text, so texts
    and literals are joined by it; paths and literals are joined by the
    literals' first three characters, which a path that holds one has somewhere.
    """
    sent = F.broadcast if asked.count() <= BROADCAST_TERMS else (lambda x: x)
    wanted = asked.select("literal", F.regexp_extract("literal", r"^[A-Za-z_0-9]+", 0).alias("word")).distinct()
    words = units.select(key, F.col(text).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    near = words.join(sent(wanted), "word").where((F.col("literal") == F.col("word")) | F.rlike("_t", F.concat(F.lit(r"(?U)(?<!\w)\Q"), "literal", F.lit(r"\E(?!\w)"))))
    hits = near.select(key, "literal", F.lit(1).alias("w"))
    if path is not None:
        every = wanted.select("literal", F.substring("literal", 1, 3).alias("gram")).distinct()
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(path)))
        grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col(path), i, F.lit(n)) for n in (1, 2, 3)]))))
        held = units.select(path).distinct().select(path, F.explode(grams).alias("gram")).join(sent(every), "gram")
        held = held.where(F.contains(F.col(path), F.col("literal"))).select(path, "literal").distinct()
        hits = hits.unionByName(units.select(key, path).join(held, path).select(key, "literal", F.lit(4).alias("w")))
    best = hits.groupBy(key, "literal").agg(F.max("w").alias("w"))
    scored = best.join(sent(asked), "literal").groupBy(query, key).agg(F.sum(F.col("w") * F.col("n")).alias("score"))
    return top(scored, [query], [F.desc("score"), F.asc(key)], limit)


def top(df: DataFrame, by: list[str], order: list[Column], limit: int, out: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group with their rank from 1; tasks keep only their own best before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= limit)


def dense(vectors: DataFrame, queries: DataFrame, key: str, query: str, limit: int = 64, vector: str = "embedding", max_queries: int = 10_000, work: Observation | None = None) -> DataFrame:
    """``(query, key, score, rank)`` by dot product, brute force: a stated set of queries against all rows.

    The queries' matrix, checked against ``max_queries``, is sent to all tasks;
    each batch of rows is one product of matrices and keeps its best ``limit``
    rows of each query, of which the best of all follow.  Null vectors and
    those of another length than the queries' match nothing.  ``work`` observes
    the products of a row and a query.
    """
    held = queries.select(query, vector).where(F.col(vector).isNotNull() & F.col(query).isNotNull()).limit(max_queries + 1).collect()
    if len(held) > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes) | {"_q": dict(queries.dtypes)[query]}
    width = max((len(r[vector]) for r in held), default=0)
    held = sorted((r for r in held if len(r[vector]) == width), key=lambda r: r[query])
    shared = spark.sparkContext.broadcast((np.array([r[query] for r in held]), np.array([r[vector] for r in held], float).reshape(len(held), width)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False))
            if not len(names) or not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)
            found = np.round(matrix @ rows.T, 6)
            order = np.argsort(keys, kind="stable")
            best = order[np.argsort(-found[:, order], axis=1, kind="stable")[:, :limit]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(keys[best.ravel()]), pa.array(np.take_along_axis(found, best, 1).ravel())], [query, key, "score"])

    rows = vectors.select(key, vector)
    if work is not None:
        rows = rows.observe(work, (F.count_if(F.size(vector) == width) * len(held)).alias("dense_dot_products"))
    scored = rows.mapInArrow(score, f"`{query}` {kinds['_q']}, `{key}` {kinds[key]}, score double").where("score is not null")
    return top(scored, [query], [F.desc("score"), F.asc(key)], limit)


def fuse(lists: list[DataFrame], key: str, query: str, k: int = 60, pool: int = 64) -> DataFrame:
    """Reciprocal rank fusion: ``(query, key, score, rank)`` of lists with a ``rank``; a key counts once in each list."""
    each = None
    for one in lists:
        best = one.groupBy(query, key).agg(F.min("rank").alias("rank"))
        each = best if each is None else each.unionByName(best)
    scored = each.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top(scored, [query], [F.desc("score"), F.asc(key)], pool)


def suppress_overlaps(ranked: DataFrame, query: str, path: str = "doc_id", share: float = 0.75, keep: int = 10, pool: int = 64) -> DataFrame:
    """The first ``keep`` rows of each query that overlap no earlier kept one of the same path by more than ``share``.

    The share is of the shorter range's lines.  Sequential over a pool of at most ``pool`` rows a query.
    """
    import pandas as pd

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        taken, ends = [], {}
        for r in rows.sort_values("rank").itertuples():
            mine = ends.setdefault(getattr(r, path), [])
            if all(max(0, min(r.end, e) - max(r.start, s) + 1) <= share * min(r.end - r.start + 1, e - s + 1) for s, e in mine):
                taken.append(r.Index)
                mine.append((r.start, r.end))
            if len(taken) == keep:
                break
        return rows.loc[taken]

    held = ranked.where(F.col("rank") <= pool)
    return held.groupBy(query).applyInPandas(greedy, held.schema)


def diversified(ranked: DataFrame, query: str, path: str, key: str, penalty: float = 0.25) -> DataFrame:
    """Order in which rows are taken when each further row of a path counts ``score / (1 + penalty * taken)``.

    Within a path rows come by score, so the j-th has a known divisor and the
    greedy choice is one sort.  Adds ``effective`` and ``place``.
    """
    j = F.row_number().over(Window.partitionBy(query, path).orderBy(F.desc("score"), key)) - 1
    scored = ranked.withColumn("effective", F.round(F.col("score") / (1 + penalty * j), 9))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("effective"), key)))


def facet_greedy(pool: DataFrame, query: str, key: str, path: str, facets: str = "facets", keep: int = 10, size: int = 64) -> DataFrame:
    """Rows chosen one by one by score, times one more for each new facet, over one more quarter for each row of the path taken.

    Sequential over the first ``size`` rows of a query by score.  Adds ``place``.
    """
    import pandas as pd
    from pyspark.sql.types import IntegerType, StructField, StructType

    held = top(pool, [query], [F.desc("score"), F.asc(key)], size, "_r").drop("_r")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rest, seen, paths, out = rows.sort_values(["score", key], ascending=[False, True]).to_dict("records"), set(), {}, []
        while rest and len(out) < keep:
            def worth(r):
                return r["score"] * (1 + len(set(r[facets]) - seen)) / (1 + 0.25 * paths.get(r[path], 0))

            best = max(rest, key=lambda r: (worth(r), -rest.index(r)))
            rest.remove(best)
            seen |= set(best[facets])
            paths[best[path]] = paths.get(best[path], 0) + 1
            out.append({**best, "place": len(out) + 1})
        return pd.DataFrame(out)

    return held.groupBy(query).applyInPandas(greedy, StructType([*held.schema.fields, StructField("place", IntegerType())]))
