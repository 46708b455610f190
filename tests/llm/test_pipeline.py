"""The pipeline's stages, each on what the one before kept, against plain code."""

from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.test_near_duplicate_rows import brute_rows
from tests.llm.test_operators import brute_spans


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(10_001, "12 34 !?", "en", "s", 8), (10_002, None, "en", "s", 0), (10_003, "write to the one and only anna@mail.org about the house and the garden", "en", "s", 70)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    folder = tmp_path / "sf"
    docs.write.parquet(str(folder / "documents.parquet"))
    kept = spark.read.parquet(str(folder / "documents.parquet"))
    seen = {"start": kept.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(folder))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen[name] = kept.collect()
    ids = lambda k: {r.doc_id for r in seen[k]}
    assert ids("start") - ids("language") == {10_001, 10_002}
    language = [(r.doc_id, r.text, "") for r in seen["language"]]
    assert ids("near_duplicates") == {min(language[i][0] for i in group) for group in brute_rows(language, 5)[1]}  # five words
    before = {r.doc_id: r.text for r in seen["near_duplicates"]}
    assert {r.doc_id for r in seen["personal_data"]} == set(before)
    for r in seen["personal_data"]:
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not brute_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert "[EMAIL]" in {r.doc_id: r.text for r in seen["personal_data"]}[10_003]
    assert {r.doc_id for r in seen["packing"]} == set(before)
    ran = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in ran)[:3] and {r.doc_id for r in ran} == set(before)
    assert sum(r.length for r in ran) == sum(r.length for r in seen["packing"])
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
