from collections import Counter

import corpus_pipeline
from docjson.llm.store import materialise


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialise(stage(spark, docs, sf), name)
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "exact_dedup", "ngram_join"):
            assert len(after) == len(set(after)) and len(after) > 0.6 * len(before)
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "mixing":
            assert max(Counter(after).values()) <= 3
            mixed = Counter(after)
        counts.append(len(after))
    assert Counter(r["doc_id"] for r in docs.filter("start = 0").collect()) == mixed
    # Too few toxic labels here for the model to reject anything; tests/llm/test_models.py holds the filter.
    assert counts[1] <= counts[0] and counts[2] < counts[1]


def test_every_operator_has_a_query():
    from docjson.llm.queries import QUERIES

    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 11))
