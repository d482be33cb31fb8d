"""The pipeline over awkward rows, and against its stages' rules on a small table."""

from __future__ import annotations

import corpus_pipeline as pipeline
from tests.llm import data
from tests.llm.test_operators import plain_matches


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_stages_keep_columns_and_rows(spark, tmp_path):
    docs = data.documents(spark)
    write(docs, tmp_path, "documents")
    marks = data.labels(spark, docs, "toxic").selectExpr("doc_id", "0 as toxic", "1 as quality")
    write(marks, tmp_path, "labels")
    bench = spark.createDataFrame([(1, "w1 x1 w2 x2 w3 x3 w4 x4 w5 x5 w6 x6 w7 x7")], "item_id bigint, text string")
    write(bench, tmp_path, "benchmark")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name in ("toxicity", "quality"):
            assert out.count() == docs.count()
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_pieces", "piece_ids"]
    empty = tmp_path / "empty"
    for name, frame in (("documents", docs), ("labels", marks), ("benchmark", bench)):
        write(frame.limit(0), empty, name)
    assert pipeline.run(spark, str(empty)).collect() == []


def test_run_is_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = pipeline.without_toxic(spark, docs, folder)
    good = pipeline.of_quality(spark, toxic, folder).collect()
    least = {i for i, n, c in data.linked([(r.doc_id, r.text) for r in good]) if not n or i == c}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = set()
    for r in good:
        if r.doc_id in least:
            n, hit, _ = plain_matches(r.text, items)
            if not (hit and 20 * hit >= n):
                clean.add(r.doc_id)
    assert {r.doc_id for r in pipeline.run(spark, folder).collect()} == clean and clean
