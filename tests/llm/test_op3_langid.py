import pytest
from pyspark.sql import functions as F

from tradetally.llm import op3_langid as op
from tradetally.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return op.train(spark, docs.where(fold("doc_id", 5) != 0), "doc_id", "text", "lang")


def test_families():
    assert op.family("de") == op.family("EN-us") == "germanic" and op.family("pt_BR") == "romance"
    assert op.family("xx") != op.family("yy")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = op.query(spark, SF)
    assert out.count() == docs.count()
    both = out.join(docs, "doc_id").where("held_out and lang is not null")
    total, right = both.count(), both.where("lang = lang_pred").count()
    assert total > 100 and right >= 0.95 * total
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_edge_texts(spark, model):
    rows = [(1, None), (2, ""), (3, " 123 !? "), (4, "a"), (5, "é"), (6, "und der die " * 30000), (6, "und der die"), (None, "the and of")]
    docs = spark.createDataFrame([(i, t, 0.5, "q") for i, t in rows], "doc_id long, text string, score double, lang string")
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in op.identify(spark, docs, model).collect())
    assert len(got) == len(rows)
    by = {i: (p, s) for i, p, s in got}
    assert by["1"] == by["2"] == by["3"] == ("und", 0.0)
    assert by["4"][0] in model.langs and by["5"][0] in model.langs and by["None"][0] == "en"
    assert op.identify(spark, docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in op.identify(spark, docs, None).collect()} == {"und"}


def test_training_on_little(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "text", None), (2, None, "en"), (3, "1", "en")], schema)
    assert op.train(spark, none, "doc_id", "text", "lang") is None
    one = op.train(spark, spark.createDataFrame([(1, "hello", "en")], schema), "doc_id", "text", "lang")
    got = op.identify(spark, spark.createDataFrame([(1, "what", "x")], schema), one).first()
    assert got.lang_pred == "en" and 0 <= got.score <= 1


def test_sample_is_bounded(spark):
    from tradetally.llm.common import sample_of
    df = spark.range(20000).select("id", (F.col("id") % 10 == 0).cast("int").alias("l"))
    n = {r.l: r["count"] for r in sample_of(df, "id", "l", 300).groupBy("l").count().collect()}
    assert all(200 < x < 400 for x in n.values()) and len(n) == 2
