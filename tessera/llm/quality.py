"""Quality classification by co-training on two views of a document.

One view is the text's content (shares of capitals, symbols, digits, repeated
words and lines, lengths), the other the page's metadata (source, language,
declared length).  Both start from the same labels.  In each round each
classifier labels the pool's documents it is most sure of, for the other one
to learn from.  At the end both views are calibrated on labels held out from
all rounds, a logistic model combines the two calibrated log-odds, and all
documents are scored.

What is fitted is fitted on bounded samples, chosen by a hash of the id: at
most ``sample_rows`` labelled and ``pool_rows`` unlabelled documents.  Scoring
covers every document and its whole text.

Documents are accepted from a score of ``threshold`` on.  Null text counts as
empty, null metadata as a value of its own.  Where labels are missing or of one
kind only, every document gets their mean (or 1) as its score.  Labels that
repeat an id are averaged, repeated documents of a sampled id are one row of the
fit (the one with the least features) and scored each, whole however long.  An
empty table gives an empty table.  Other columns pass through; those named like
an output are replaced.
"""

from __future__ import annotations

import uuid
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import held
from tessera.llm.linear import Logistic, folds, sigmoid

SOURCE_SLOTS, LANG_SLOTS = 48, 12
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in " .,;:'\"?!()-\n\r\t"]] = True


def content_features(text: str | None) -> list[float]:
    """Of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    digits, high = int(count[48:58].sum()), int(count[128:].sum())
    plain = int(count[_PLAIN].sum())
    symbols = len(data) - upper - lower - digits - high - plain
    words = data.split()
    w = max(1, len(words))
    again = sum(map(eq, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    return [
        np.log1p(len(data)),
        upper / max(1, upper + lower),
        symbols / n,
        float(count[33]) / n,
        float(count[124]) / w,
        digits / n,
        high / n,
        float(count[10]) / n,
        len(data) / w,
        len(set(words)) / w,
        len(set(words)) / np.sqrt(w),
        again / w,
        float(again > 2),
        len(set(lines)) / max(1, len(lines)),
        float(symbols > 0.02 * n),
        float(upper > 0.3 * max(1, upper + lower)),
    ]


def metadata_features(source, lang, n_chars) -> list[float]:
    one = [0.0] * (SOURCE_SLOTS + LANG_SLOTS)
    one[zlib.crc32(str(source).encode()) % SOURCE_SLOTS] = 1.0
    one[SOURCE_SLOTS + zlib.crc32(str(lang).encode()) % LANG_SLOTS] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    return [*one, size, size * size, float(n_chars is None)]


class CoTrained:
    """Two calibrated views and their combination."""

    def __init__(self, rounds: int = 5, per_round: int = 200, sure: float = 0.97):
        self.rounds, self.per_round, self.sure = rounds, per_round, sure
        self.constant: float | None = None

    def fit(self, x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray]) -> CoTrained:
        """``x`` and ``pool`` hold the two views' rows; ``y`` is 0 or 1."""
        if len(y) < 20 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        held = folds(len(y), 4) == 0
        if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            self.constant = float(y.mean())
            return self
        rows, labels = [v[~held] for v in x], [y[~held].astype(float)] * 2
        left = np.ones(len(pool[0]), bool)
        self.views = [Logistic().fit(rows[v], labels[v]) for v in (0, 1)]
        for _ in range(self.rounds):
            given = [None, None]
            for v in (0, 1):
                p = self.views[v].predict(pool[v]) if len(pool[v]) else np.empty(0)
                rate = labels[v].mean()
                take = []
                for sign, share in ((1, rate), (0, 1 - rate)):
                    order = np.argsort(-p if sign else p)
                    ok = order[left[order] & ((p[order] >= self.sure) if sign else (p[order] <= 1 - self.sure))]
                    take.append((ok[: max(1, round(self.per_round * share))], float(sign)))
                given[1 - v] = take
            for v in (0, 1):
                for at, sign in given[v]:
                    rows[v] = np.vstack([rows[v], pool[v][at]])
                    labels[v] = np.concatenate([labels[v], np.full(len(at), sign)])
            for take in given:
                for at, _ in take:
                    left[at] = False
            self.views = [Logistic().fit(rows[v], labels[v]) for v in (0, 1)]
        calibrating = [self.views[v].logit(x[v][held])[:, None] for v in (0, 1)]
        self.platt = [Logistic(l2=0.1).fit(c, y[held]) for c in calibrating]
        both = np.hstack([self.platt[v].logit(calibrating[v])[:, None] for v in (0, 1)])
        self.blend = Logistic(l2=0.1).fit(both, y[held])
        return self

    def predict(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities: of the content, of the metadata, of both."""
        if self.constant is not None:
            p = np.full(len(content), self.constant)
            return p, p, p
        own = [self.platt[v].logit(self.views[v].logit(x)[:, None]) for v, x in ((0, content), (1, metadata))]
        return sigmoid(own[0]), sigmoid(own[1]), self.blend.predict(np.stack(own, axis=1))


def _views(columns) -> tuple[np.ndarray, np.ndarray]:
    texts, sources, langs, sizes = columns
    content = np.array([content_features(x.as_py()) for x in texts]).reshape(len(texts), -1)
    meta = [metadata_features(*r) for r in zip(sources.to_pylist(), langs.to_pylist(), sizes.to_pylist())]
    return content, np.array(meta).reshape(len(texts), -1)


def _inputs(names: tuple[str, str, str, str]) -> list[Column]:
    text, source, lang, size = names
    return [F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(size).cast("double")]


COLUMNS = ("text", "source", "lang", "n_chars")


def train_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", columns=COLUMNS, sample_rows: int = 12_000, pool_rows: int = 8_000) -> CoTrained:
    @arrow_udf("struct<content:array<double>,metadata:array<double>>")
    def features(*given: pa.Array) -> pa.Array:
        held("quality", object)  # frees what an earlier step has left
        content, meta = _views(given)
        return pa.StructArray.from_arrays([pa.array(list(content), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))], ["content", "metadata"])

    known = labels.where(f"{id} is not null and {label} is not null").groupBy(id).agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    by_hash = F.xxhash64(F.col(id).cast("string"))
    sample = known.orderBy(by_hash, id).limit(sample_rows)
    others = docs.select(id).where(f"{id} is not null").join(F.broadcast(sample.select(id)), id, "left_anti")
    # four times as many rows, as ids may repeat
    pool = others.orderBy(by_hash, id).limit(4 * pool_rows).distinct().orderBy(by_hash, id).limit(pool_rows)
    wanted = sample.unionByName(pool.withColumn("_y", F.lit(None).cast("double")))  # at most sample_rows + pool_rows ids
    taken = docs.select(F.col(id), *columns).join(F.broadcast(wanted), id).select(id, "_y", features(*_inputs(columns)).alias("f"))
    rows = taken.groupBy(id).agg(F.first("_y").alias("_y"), F.min("f").alias("f")).select(id, "_y", "f.*").collect()
    rows.sort(key=lambda r: (r[id], r["content"]))
    lab, free = [r for r in rows if r["_y"] is not None], [r for r in rows if r["_y"] is None]
    width = (len(content_features("")), SOURCE_SLOTS + LANG_SLOTS + 3)
    view = lambda part: [np.array([r[n] for r in part]).reshape(len(part), k) for n, k in zip(("content", "metadata"), width)]
    return CoTrained().fit(view(lab), np.array([r["_y"] for r in lab]), view(free))


def score_quality(docs: DataFrame, model: CoTrained, columns=COLUMNS, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``content_score, metadata_score, score double, accepted boolean``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @arrow_udf("struct<content_score:double,metadata_score:double,score:double>")
    def score(*given: pa.Array) -> pa.Array:
        model = held(("quality", name), lambda: shared.value)
        got = model.predict(*_views(given)) if len(given[0]) else [np.empty(0)] * 3
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in got], ["content_score", "metadata_score", "score"])

    return (
        docs.drop("content_score", "metadata_score", "score", "accepted")
        .withColumn("_q", score(*_inputs(columns)))
        .select("*", "_q.*")
        .drop("_q")
        .withColumn("accepted", F.col("score") >= threshold)
    )
