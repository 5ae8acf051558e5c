import corpus_pipeline
from tests.llm.data import SCHEMA, documents, frame, prose


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, documents(7), clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.count() <= 3 * docs.count()
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_run_takes_decisions(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [(i, prose(rng, 150, "abcdefgh"), "en", f"s{i % 2}", 1) for i in range(40)]
    near = rows[0][1].split(" ")
    near[70] = "zz"
    rows += [(100, rows[1][1], "en", "s0", 1), (101, " ".join(near), "en", "s0", 1), (102, None, "en", "s1", 0), (103, "too short", "en", "s1", 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not ids & {100, 101, 102, 103}
    assert len(ids) >= 30


def test_no_text_is_lost_where_rows_share_a_doc_id(spark, tmp_path):
    import random

    rng = random.Random(9)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (9, c), (9, d), (None, a), (None, c), (None, prose(rng, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (5, b), (9, c), (9, d), rows[-1]], key=str)
