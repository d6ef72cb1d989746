"""What the pipeline's Arrow steps cost an executor: each text goes to Python once, in slices that bound the arrays over it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality, textbytes, winnowing

ROWS = [(i, " ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(200)), i % 2, len(str(i))) for i in range(300)]
DOCS = "doc_id long, text string, label int, n_chars long"
MODEL = quality.fit([], np.zeros((0, quality.STATS + 1)), np.zeros(0))


def scored(docs):
    return quality.score(docs, MODEL, metadata=["n_chars"])


def decontaminated(docs):
    items = docs.sparkSession.createDataFrame([(1, ROWS[5][1]), (2, "w1 w2")], "item_id long, text string")
    return winnowing.drop_contaminated(docs, items)


@pytest.mark.parametrize("step", [scored, decontaminated])
def test_texts_go_to_python_once(spark, monkeypatch, step):
    docs, sent = spark.createDataFrame(ROWS, DOCS), []
    whole = docs.toArrow().nbytes
    kind = type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow, **b: sent.append(self) or f(self, *a, **b))
    assert step(docs).count() > 0
    assert whole <= sent[-1].toArrow().nbytes < 1.5 * whole


@pytest.mark.parametrize("step", [scored, decontaminated])
def test_texts_of_other_types(spark, step):
    docs = spark.createDataFrame(ROWS, DOCS)
    told = lambda df: sorted((r.doc_id, r["score"] if step is scored else 0) for r in step(df).collect())
    assert told(docs.withColumn("text", F.col("text").cast("binary"))) == told(docs) != []
    numbers = docs.withColumn("text", F.col("doc_id"))
    assert step(numbers).schema["text"].dataType == numbers.schema["text"].dataType
    assert told(numbers) == told(numbers.withColumn("text", F.col("text").cast("string")))


def test_scores_in_place_of_the_text(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    told = quality.score(docs, MODEL, metadata=["n_chars"], into="text")
    assert sorted((r.doc_id, r.text) for r in told.collect()) == sorted((r.doc_id, r.score) for r in scored(docs).collect())


def test_arrays_over_a_text_are_bounded(monkeypatch):
    column = pa.array([" ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(400)) for i in range(2000)])
    monkeypatch.setattr(textbytes, "_powers", [])
    tracemalloc.start()
    try:
        assert sum(1 for _ in quality.features(column)) == 2000
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()
