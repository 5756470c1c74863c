from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import brute


def test_stages_on_the_small_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, results = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        function(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results[name] = ({row.doc_id: row.text for row in before.collect()}, docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    # Near duplicates: one document of each group that all pairs give.
    had, kept = results["near_duplicates"]
    groups = brute.near_duplicates(list(had.items()), length=5)
    assert {row.doc_id for row in kept} == {doc for doc, (_, first) in groups.items() if doc == first}
    # Decontamination: exactly the rows without a benchmark window.
    had, kept = results["decontamination"]
    items = [tuple(row) for row in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination(list(had.items()), items)
    assert {row.doc_id for row in kept} == {doc for doc, (_, hit, _) in hits.items() if not hit}
    # Mixing: sources near their targets, nothing more than three times.
    had, mixed = results["mixing"]
    assert max(Counter(row.doc_id for row in mixed).values()) <= 3
    taken, size, most = defaultdict(int), defaultdict(int), 0
    for row in mixed:
        taken[row.source] += len(brute.words(row.text))
    for row in results["decontamination"][1]:
        words = len(brute.words(row.text))
        size[row.source] += words
        most = max(most, words)
    for source, target in brute.targets(size).items():
        assert -most < taken[source] - target <= 1e-6
    # Sharding: all rows, counts at most one apart.
    _, sharded = results["sharding"]
    assert Counter(row.doc_id for row in sharded) == Counter(row.doc_id for row in mixed)
    counts = Counter(row.shard for row in sharded)
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1


def test_classifier_keeps_good_and_drops_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {row.doc_id for row in corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [row.doc_id for row in labels if row.quality and not row.toxic]
    bad = [row.doc_id for row in labels if not row.quality or row.toxic]
    assert sum(doc in kept for doc in good) / len(good) > 0.95
    assert sum(doc in kept for doc in bad) / len(bad) < 0.5


def test_run_gives_shards(spark, sf):
    result = corpus_pipeline.run(spark, sf)
    assert result.columns[-2:] == ["shard", "slot"] and result.count() > 0
