from __future__ import annotations

import pandas as pd

import corpus_pipeline
from listingmart.llm import decontam, simhash


def test_stages(spark, data, tmp_path):
    docs, sizes = spark.read.parquet(f"{data}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        before = docs
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.join(before, columns, "left_anti").count() == 0  # no text is changed
        if name == "near_duplicates":
            classes = simhash.near_duplicates(before).toPandas()
            assert sorted(docs.toPandas().doc_id) == sorted(classes.component_id.unique())
        if name == "decontamination":
            hit = {r["doc_id"] for r in decontam.contaminated(before, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
            assert set(docs.toPandas().doc_id) == set(before.toPandas().doc_id) - hit
    assert sizes[4] == sizes[3] and sizes[1] <= sizes[0] <= 200
    rows = docs.toPandas().sort_values("start")
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum().tolist()[:-1]] and rows.doc_id.is_monotonic_increasing
    assert isinstance(rows, pd.DataFrame)


def test_run(spark, data):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) for _ in range(2))
    assert one == two and one


def test_empty(spark, awkward, nothing, data):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, data).count() == 0, name
        assert stage(spark, awkward, data).count() >= 5, name
