"""Steps that must not do their work twice, or for nothing."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import bpe, neardup, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", "it's  a \n test", "naïve 日本語 \0 12345", " x" * 3000, "it's  a \n test"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_both_is_encode_then_decode(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "both int, text string")
    one = bpe.bpe_both(docs, RANKS, PATTERN).select("both", "text", "ids", "decoded")
    two = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, PATTERN), RANKS, PATTERN).select("both", "text", "ids", "decoded")
    got = one.orderBy("both").collect()
    assert got == two.orderBy("both").collect()
    assert [bytes(r.decoded) for r in got] == [(t or "").encode() for t in TEXTS]


@pytest.mark.parametrize("of", [lambda s: queries.op1_byte_bpe(s, "/root/testdata/sf0.001"), lambda s: corpus_pipeline.encoding_stage(s, queries.table(s, "/root/testdata/sf0.001", "documents"), "")])
def test_texts_are_encoded_once(spark, of):
    plan = _plan(of(spark))
    line = next(x for x in plan.split("\n") if "ArrowEvalPython" in x)
    assert plan.count("ArrowEvalPython") == 1 and "pythonUDF1" not in line and line.count("(text") == 1


def test_no_linked_pair_is_ruled_out_and_common_passages_are(spark):
    """Sets with parts in common, small and large, of which some reach the similarity."""
    rng, rows = np.random.default_rng(4), []
    for n in (1, 2, 5, 40, 300, 3000):
        for kept in (1.0, 0.9, 0.8, 0.5, 0.2):
            common = rng.integers(0, 2**63, max(1, int(n * kept)), dtype=np.uint64)
            rows += [[np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in "ab"]]
    lanes = lambda s: [0] * neardup.LANES + neardup.odds(s).tolist()
    both = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    table = spark.createDataFrame([(k, lanes(a), lanes(b), len(a), len(b)) for k, (a, b) in enumerate(rows)], "k int, a array<long>, b array<long>, n long, m long")
    kept = {r.k for r in table.where(neardup.may_link("a", "b", "n", "m", 80)).collect()}
    assert {k for k, (a, b) in enumerate(rows) if both(a, b) >= 0.8} <= kept
    assert not {k for k, (a, b) in enumerate(rows) if both(a, b) < 0.5 and 40 <= len(a) <= 300} & kept


def test_encoding_holds_few_texts_at_a_time(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        docs = spark.range(2_500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
        got = corpus_pipeline.encoding_stage(spark, docs, "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
        assert got.select("doc_id").distinct().count() == 2_500 and got.where("n_tokens = 0").isEmpty()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
