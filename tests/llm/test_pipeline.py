from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from tallyscope.session import stored


def test_stages_keep_the_columns(spark, sf_dir, documents):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        assert kept.columns == documents.columns and kept.dtypes == documents.dtypes
        seen.append(kept.count())
        docs = kept
    assert documents.count() > seen[0] > seen[1] >= seen[2] == seen[3] > 0.7 * documents.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert docs.join(labels.filter("quality = 0"), "doc_id").count() == 0


def test_run_packs_what_is_left(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    by_doc = defaultdict(int)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert all(n == total for (_, total), n in by_doc.items())


def test_odd_rows_go_through_every_stage(spark, sf_dir, nasty, empty):
    for docs in (nasty, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        assert docs.columns[:3] == ["doc_id", "start", "length"]
