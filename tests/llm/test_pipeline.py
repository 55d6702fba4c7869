"""The pipeline's stages on a small table, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from test_operators import corpus, frame, near_brute, rows_of


def test_stages(spark, tmp_path):
    docs = frame(spark, corpus())
    labels = [(100 + i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus()[20][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, current, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert after.columns == docs.columns
            left = [(r["doc_id"], r["text"]) for r in rows_of(after)]
            before = [(r["doc_id"], r["text"]) for r in rows_of(current)]
            assert not Counter(left) - Counter(before)
            if name == "quality":
                assert len(left) == len(before)  # labels of one kind reject nothing
            if name == "exact_dedup":
                assert len(left) == len({"".join((t or "").split()) for _, t in before})
            if name == "near_dedup":
                assert len(left) == near_brute(before, 5, 80)[1]
            if name == "decontamination":
                assert set(before) - set(left) == {(101, corpus()[20][1])}
        else:
            assert after.count() == current.count()
        current = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == current.count()


def test_bad_documents_go(spark, tmp_path):
    good = [(i, f"plain prose about thing {i} and what became of it in the end, told at some length") for i in range(80)]
    bad = [(100 + i, " ".join(f"$$#{i}@{k}!!" for k in range(12))) for i in range(80)]
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.good_quality(spark, frame(spark, good + bad + [(None, None)]), str(tmp_path))
    kept = {r["doc_id"] for r in rows_of(left)}
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in bad}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
