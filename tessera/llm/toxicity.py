"""Toxicity by a chain of linear classifiers.

The categories are label columns of 0 and 1, predicted one after another.  Each
link of the chain is a logistic model over the words of a text and the log-odds
of the categories before it.  In training these log-odds are out-of-fold: a row's
earlier categories are predicted by models that have not seen the row.  The last
category decides.

Features of a text are its distinct words (lower-cased runs of letters and of
numerals other than decimal digits) and the
first four, five and six letters of longer words, marked as beginnings.  The
vocabulary holds, for each category, the features whose share among its rows
differs most from the rest (smoothed log-odds over their standard error); it is
counted by Spark over all labelled documents.  Words of over 32 letters count by
their beginnings only.

The links are fitted on a bounded sample: the ``sample_rows`` labelled documents
with the least hash of their id, one text of each.  Scoring covers every document and its
whole text.

Null and empty texts, and texts without letters, have no features and score what
the labels' rates give.  Where a category's labels are missing or of one kind only,
every document gets their mean (or 0).  Labels that repeat an id count as 1 if any
is.  Rows that repeat are scored each.  An empty table gives an empty table.  Other
columns pass through; those named like an output are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import few, held, written
from tessera.llm.linear import SparseLogistic, folds

_WORD = re.compile(r"[^\W\d_]+")
LONGEST, BEGINNINGS = 32, (4, 5, 6)


def features(text: str | None) -> set[str]:
    """Distinct words, and beginnings of words with a caret after them."""
    words = set(_WORD.findall(text.lower())) if text else set()
    out = {w for w in words if len(w) <= LONGEST}
    for k in BEGINNINGS:
        out.update(w[:k] + "^" for w in words if len(w) > k)
    return out


class ToxicityChain:
    """Linear models in the order of ``categories``, over the numbered features of ``vocabulary``."""

    def __init__(self, categories: list[str], vocabulary: list[str]):
        self.categories = categories
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.links: list[SparseLogistic | float] = []

    def numbers(self, text: str | None) -> np.ndarray:
        got = map(self.number.get, features(text))
        return np.array([i for i in got if i is not None], np.int64)

    def _one(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> SparseLogistic | float:
        if not len(y) or y.min() == y.max():
            return float(y.mean()) if len(y) else 0.0
        return SparseLogistic(len(self.number)).fit(rows, dense, y)

    @staticmethod
    def _predict(model: SparseLogistic | float, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return np.full(len(rows), model) if isinstance(model, float) else model.predict(rows, dense)

    @staticmethod
    def _logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, parts: int = 4) -> ToxicityChain:
        """``rows`` hold feature numbers; ``labels`` has a column for each category."""
        part = folds(len(rows), parts)
        dense = np.empty((len(rows), 0))
        for j in range(len(self.categories)):
            y = labels[:, j]
            self.links.append(self._one(rows, dense, y))
            if j + 1 < len(self.categories):
                unseen = np.zeros(len(rows))
                for k in range(parts):
                    inside, outside = np.flatnonzero(part != k), np.flatnonzero(part == k)
                    model = self._one([rows[i] for i in inside], dense[inside], y[inside])
                    unseen[outside] = self._predict(model, [rows[i] for i in outside], dense[outside])
                dense = np.hstack([dense, self._logit(unseen)[:, None]])
        return self

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, a column for each category."""
        out, dense = np.empty((len(rows), 0)), np.empty((len(rows), 0))
        for model in self.links:
            p = self._predict(model, rows, dense)[:, None]
            out, dense = np.hstack([out, p]), np.hstack([dense, self._logit(p)])
        return out


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    id: str = "doc_id",
    text: str = "text",
    sample_rows: int = 8_000,
    words_per_category: int = 2_000,
) -> ToxicityChain:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each feature, in all and of each category, summed over what a task has read since it last gave rows."""
        names = ["w", "n", *categories]
        held: dict[str, list[int]] = {}

        def given() -> pa.RecordBatch:
            rows = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names) - 1)]], names)

        for batch in batches:
            labels_of = list(zip(*[batch.column(1 + k).to_pylist() for k in range(len(categories))]))
            for x, y in zip(batch.column(0), labels_of):
                for w in features(x.as_py()):
                    row = held.get(w)
                    if row is None:
                        row = held[w] = [0] * (len(names) - 1)
                    row[0] += 1
                    if any(y):
                        for k, v in enumerate(y):
                            row[1 + k] += v
                if len(held) > 200_000:
                    yield given()
                    held.clear()
        yield given()

    known = labels.where(F.col(id).isNotNull()).groupBy(id).agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories])
    known = written(known, "toxic-labels")
    sample = known.orderBy(F.xxhash64(F.col(id).cast("string")), id).limit(sample_rows)
    rows = docs.select(id, F.col(text).alias("_t")).join(few(known), id).select("_t", *categories)
    totals = docs.select(id).join(few(known), id).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    parts = rows.mapInArrow(counted, ", ".join(["w string", "n long", *[f"`{c}` long" for c in categories]]))
    each = written(parts.groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in categories]).where("n >= 3"), "toxic-words")
    best = None
    for c in categories:
        n, all_c = totals["n"], totals[c] or 0
        inside, outside = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        odds = F.log(inside / (all_c + 1.0 - F.col(c))) - F.log(outside / (n - all_c + 1.0 - F.col("n") + F.col(c)))
        top = each.select("w", F.abs(odds / F.sqrt(1 / inside + 1 / outside)).alias("z")).orderBy(F.desc("z"), "w").limit(words_per_category)
        best = top if best is None else best.unionByName(top)
    vocabulary = sorted({r["w"] for r in best.select("w").collect()})  # at most words_per_category for each category
    chain = ToxicityChain(list(categories), vocabulary)

    @arrow_udf("array<int>")
    def numbered(texts: pa.Array) -> pa.Array:
        return pa.array([np.sort(chain.numbers(x.as_py())).tolist() for x in texts], pa.list_(pa.int32()))

    taken = docs.select(id, F.col(text).alias("_t")).join(F.broadcast(sample), id).select(id, *categories, numbered("_t").alias("_f"))
    taken = taken.groupBy(id, *categories).agg(F.min("_f").alias("_f")).collect()  # at most sample_rows
    taken.sort(key=lambda r: r[id])
    return chain.fit([np.array(r["_f"], np.int64) for r in taken], np.array([[r[c] for c in categories] for r in taken], float).reshape(len(taken), len(categories)))


def score_toxicity(docs: DataFrame, chain: ToxicityChain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``<category>_score double`` for each category and ``flagged boolean``, by the last category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    name = uuid.uuid4().hex
    names = [f"{c}_score" for c in chain.categories]

    @arrow_udf(f"struct<{','.join(f'{n}:double' for n in names)}>")
    def score(texts: pa.Array) -> pa.Array:
        own = held(("toxicity", name), lambda: shared.value)
        got = own.predict([own.numbers(x.as_py()) for x in texts])
        return pa.StructArray.from_arrays([pa.array(got[:, j], pa.float64()) for j in range(len(names))], names)

    return (
        docs.drop(*names, "flagged")
        .withColumn("_x", score(F.col(text)))
        .select("*", "_x.*")
        .drop("_x")
        .withColumn("flagged", F.col(names[-1]) >= threshold)
    )
