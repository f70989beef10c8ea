import os

import pytest

import corpus_pipeline as P
from updatelens.llm import decontamination, mixing, quality, sharding, simhash
from updatelens.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def test_stages_take_effect_on_what_is_left(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    bench = table(spark, FOLDER, "benchmark")
    rejected = {r.doc_id for r in quality.score_quality(docs, table(spark, FOLDER, "labels")).where("predicted = 0").collect()}
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES:
        before, docs = docs, P.materialize(stage(spark, docs, FOLDER))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "quality":
            assert set(now) == left - rejected
        if name == "near_duplicates":
            groups = simhash.near_duplicates(before, simhash.SIMILAR).collect()
            assert sorted(now) == sorted({r.component_id for r in groups})
        if name == "decontamination":
            items = [(r.item_id, decontamination.normal(r.text)) for r in bench.collect()]
            index = decontamination.Index(items, decontamination.Leak())
            assert sorted(now) == sorted(r.doc_id for r in before.collect() if not index.leaks([decontamination.normal(r.text)])[0])
        if name == "mixing":
            assert len(now) == sum(r.copies for r in mixing.mix(before).collect())
        if name == "sharding":
            assert len(now) == before.count() and sharding.shard(before).columns == docs.columns
        left = set(now)


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, FOLDER).columns[:2] == ["doc_id", "size"]
