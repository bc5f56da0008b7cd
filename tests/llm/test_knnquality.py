import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.data import docs
from tracespool.llm import knnquality
from tracespool.llm.crossparse import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_labels(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = knnquality.score(table, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    hidden = labels.where(~held_out(F.col("doc_id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knnquality.score(table, hidden).collect()))


def test_votes_against_plain_search(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = knnquality.Model(knnquality.sample(table, labels))
    texts = [r.text for r in table.limit(40).collect()]
    got = model.score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        v = knnquality.terms(pa.array([text]))[0] @ model.fold
        near = (v / np.linalg.norm(v)) @ model.vectors
        best = np.argsort(-near, kind="stable")[:knnquality.NEIGHBOURS]
        weight = np.maximum(near[best], 1e-6) ** knnquality.POWER
        assert abs(score - (weight * model.labels[best]).sum() / weight.sum()) < 1e-4


def test_awkward_and_empty(spark):
    table = docs(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (14, 0, 0), (12, 1, None), (None, 1, 0), (8, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = knnquality.score(table, labels).collect()
    assert len(got) == table.count() and all(r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    none = labels.limit(0)
    assert {r.score for r in knnquality.score(table, none).collect()} == {0.0}
    assert knnquality.score(docs(spark, []), labels).count() == 0
