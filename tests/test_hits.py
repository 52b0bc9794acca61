"""Queries over the best passages of items; before, postings and pairs of item and passage were shuffled in each."""

import pytest

from tessera.operators import ranking
from tessera.plans import catalog

NAMES = [
    "q101_span_quality",
    "q145_planned_bm25",
    "q79_undelivered",
    "q132_work",
    "q16_fusion",
    "q17_diversity",
    "q18_delivery",
    "q19_merged_ranges",
    "q65_higher_score",
    "q69_retrieval_quality",
    "q89_references",
    "q97_json_delivery",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_postings_are_shuffled(spark, monkeypatch, name):
    def shuffled(*a, **b):
        raise AssertionError("postings are shuffled")

    monkeypatch.setattr(ranking, "postings", shuffled)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns
