import zlib

import numpy as np
from pyspark.sql import functions as F

from kvspark.llm import language

SF = "/root/testdata/sf0.01"


def test_query_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.query(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.recognised(docs).count() > 0.98 * len(rows)


def test_training_reads_whole_texts(spark):
    rows = [(i, "zz " * 3000 + ("le chat noir " if i % 2 else "the black cat ") * 40, "fr" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.sample(docs, 50, "doc_id", "text", "lang").selectExpr("min(length(text)) n").head().n > 9400
    got = language.predict(docs.limit(0).unionByName(spark.createDataFrame([(1, "le chat noir", None), (2, "the black cat", None)], docs.schema)), language.train(docs, steps=120)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "fr", 2: "en"}


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    net = language.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cells = rng.integers(97, 123, (5, 12)).astype(np.uint8)
    truth = np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(net.states(cells))
        return -np.log(p[truth, :, np.arange(5)]).mean()

    slopes = net.slopes(cells, truth)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(slopes[k]).argmax(), v.shape)
        was = v[at]
        v[at] = was + 1e-2
        up = loss()
        v[at] = was - 1e-2
        down = loss()
        v[at] = was
        assert abs((up - down) / 2e-2 - slopes[k][at]) < 2e-3


def test_cases(spark):
    rows = [(i, "le chat est une bête", "fr", 1) for i in range(1, 40)] + [(i, "the dog was here", "en", 2) for i in range(40, 80)]
    rows += [(90, None, "fr", 1), (91, "", None, 1), (92, "12 3!", "en", 1), (None, "the dog", None, 1), (93, "the dog was " * 20000, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = {r.doc_id: r for r in language.identify(docs, steps=80).collect()}
    assert got[90].lang_pred == got[91].lang_pred == got[92].lang_pred == "und"
    assert got[93].lang_pred == got[None].lang_pred == "en" and got[5].lang_pred == "fr"
    assert {(r.lang_pred, r.score) for r in language.query(docs.where("lang is null and doc_id = 91")).collect()} == {("und", 0.0)}
    assert language.query(docs.limit(0)).collect() == []
    kept = language.recognised(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {90, 91, 92}
    unlabelled = docs.drop("lang").withColumn("lang", F.lit(None).cast("string"))
    assert language.recognised(unlabelled).count() == kept.count()
    assert language.Network(["x"]).positions("ab é".encode()) == ["x"] * 5
