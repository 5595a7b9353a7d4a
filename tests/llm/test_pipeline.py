"""The pipeline's stages, each on its own input, against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestone.llm import queries, secrets

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, DATA).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(tuple(s.columns) == cp.COLUMNS for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1")
    kept = good.join(stages[1], "doc_id", "left_semi").count()
    assert kept >= 0.99 * good.count()
    bad = labels.where("quality = 0")
    assert bad.join(stages[1], "doc_id", "left_semi").count() <= 0.2 * bad.count()
    assert stages[1].exceptAll(stages[0]).isEmpty()


def test_one_of_equal_documents_stays(stages):
    texts = stages[1].select("text").distinct().count()
    left = stages[2].select("text").distinct().count()
    assert stages[2].count() == left <= texts
    assert stages[2].exceptAll(stages[1]).isEmpty()


def test_different_texts_under_one_id_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(5, text(0)), (5, text(0)), (5, text(1)), (5, text(2)), (3, text(2)), (9, text(1)), (7, text(3)), (6, text(3)), (8, None), (8, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"] or "") for r in cp.near_duplicates(spark, docs, DATA).collect())
    assert got == sorted([(5, text(0)), (5, text(1)), (3, text(2)), (6, text(3)), (8, ""), (8, "")])


def test_secrets_go_and_documents_stay(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        base = secrets.base_spans(text)
        assert not secrets.base_spans(after[i]["text"]) and (after[i]["text"] != text or not base)
        assert base == [] or after[i]["n_chars"] == len(after[i]["text"])
    assert any(secrets.base_spans(t) for t in before.values())


def test_mix_takes_whole_documents(spark, stages):
    rates = {r["doc_id"]: r["copies"] for r in cp.mixing.mix(stages[3], queries.domain_labels(spark.read.parquet(f"{DATA}/labels.parquet")), cp.TARGETS).collect()}
    taken = {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert taken == {i: n for i, n in rates.items() if n}
    assert stages[4].distinct().exceptAll(stages[3]).isEmpty()


def test_packing_holds_all(stages):
    placed = stages[5].toPandas()
    assert len(placed[placed.piece == 0]) == stages[4].count()
    for _, own in placed.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "x", "en", "a", 1), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13)]
    types = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, types).withColumn("score", F.lit(0)).withColumn("id", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()} <= {1, 2, 3}
    spark.createDataFrame([], types).write.parquet(str(tmp_path / "e/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e/labels.parquet"))
    assert cp.run(spark, str(tmp_path / "e")).count() == 0
