"""Each stage of the pipeline alone: nulls in any column, odd texts, ties, repeats, empty tables, extra columns; rows that differ in one value only."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tickloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Eine sehr lange Zeile, mit Worten und mehr. " * 5_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again, until night falls.", "en", "a", 80),
    (1, "The quick brown fox jumps over the lazy dog, again and again, until night falls.", "en", "a", 80),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n", "de", None, 3),
    (5, LONG, "de", "b", len(LONG)),
    (None, "Ohne Nummer, aber mit Text und Wort.", "de", "b", 30),
    (6, "12345 !!! ###", None, "b", 13),
]
EXTRA = ("score", "row", "id", "shard", "epochs", "spans", "k", "told", "nth", "my col", "a.b")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels and a benchmark of few rows, some null."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again until"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def counted(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_edges(spark, sf, docs, stage):
    wide = docs.withColumns({c: F.lit("mine") for c in EXTRA})
    plain = counted(stage(spark, docs, sf))
    assert set(plain) <= set(counted(docs)) and counted(stage(spark, wide, sf)) == plain
    out = stage(spark, wide, sf)
    assert set(wide.columns) <= set(out.columns)
    kept = [c for c in EXTRA if not (stage is cp.shard and c == "shard")]
    assert {tuple(r[c] for c in kept) for r in out.collect()} <= {("mine",) * len(kept)}
    if stage is not cp.shard:
        assert out.columns == wide.columns
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_what_each_stage_keeps(spark, sf, docs):
    given = counted(docs)
    assert counted(cp.decontaminate(spark, docs, sf)) == Counter({k: n for k, n in given.items() if k[0] != 1})
    # of the three texts without words and of the repeated row one each
    assert {k[0] for k in counted(cp.drop_near_duplicates(spark, docs, sf)).elements()} == {1, 2, 5, 6, None}
    assert sum(counted(cp.drop_near_duplicates(spark, docs, sf)).values()) == 5
    assert counted(cp.shard(spark, docs, sf)) == given
    assert all(n <= 2 * given[k] for k, n in counted(cp.mix_sources(spark, docs, sf)).items())


def test_rows_whose_values_trade_columns(spark, sf):
    """A value is told from the same value in another column, whatever nulls stand between them."""
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    rows = [(None, a, None, b, None), (None, None, a, b, None), (None, b, a, None, None), (None, a, b, None, None), (None, "null", None, None, None), (None, None, "null", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert df.select(simhash.row_hash(df).alias("h")).distinct().count() == 6
    # texts: a twice, b, none twice (one group), "null"
    assert Counter(r.text for r in cp.drop_near_duplicates(spark, df, sf).collect()) == Counter([a, b, None, "null"])
