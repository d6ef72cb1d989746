"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import annsearch, langid, mixing, pii, quality, sharding, simhash, tagpaths, tokencount, winnowing
from tickloom.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Eine sehr lange Zeile, mit Worten und mehr. " * 20_000
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


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, DOCS)
    # columns whose names the operators use themselves
    clash = "row score size shard spans items keys sig digest pii t k hi lo rank e w part shared id c0 place whole cut of n nth lo_ hi_ told".split()
    odd = ["_row", "_score", "_place", "_source", "_pii", "_copy", "my col", "a.b", "x`y"]
    return rows.withColumns({c: F.lit("mine") for c in clash + odd})


def unharmed(given, out, but=()):
    """The columns of the input are all there, and those that no operator sets hold what they held."""
    assert set(given.columns) <= set(out.columns)
    mine = [c for c, v in zip(given.columns, given.first()) if v == "mine" and c not in but]
    names = ["`" + c.replace("`", "``") + "`" for c in mine]
    assert {tuple(r) for r in out.select(*[F.col(c) for c in names]).distinct().collect()} <= {("mine",) * len(mine)}


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (5, 1), (6, 0), (None, 1), (4, None), (1, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again until night"), (2, None), (3, ""), (4, "Wort"), (None, "lazy dog again")], "item_id long, text string")


def ids(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0) for r in df.collect()))


GIVEN = sorted((r[0] is not None, r[0] or 0) for r in ROWS)


def test_language(docs, none):
    model = langid.train(docs, landmarks=4)
    out = langid.predict(docs, model)
    assert ids(out) == GIVEN
    unharmed(docs, out, ["score"])
    told = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert told[2] == told[3] == told[4] == told[6] == ("und", 0.0)
    assert told[5][0] == "de" and told[1][0] == "en"
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_sharding(docs, none):
    out = sharding.assign_shards(docs, shards=3)
    assert ids(out) == GIVEN
    for shard in range(3):
        slots = sorted(r.slot for r in out.collect() if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in out.collect() if r.doc_id in (2, 3)} == {8}
    assert sharding.assign_shards(none).count() == 0
    assert sharding.with_shards(docs).count() == len(ROWS)
    unharmed(docs, sharding.with_shards(docs), ["shard"])
    with pytest.raises(ValueError):
        sharding.jump_shards(F.lit(1), 0)


def test_sharding_moves_only_into_the_new_shard(spark):
    keys = spark.range(2000).select(F.col("id").alias("doc_id"))
    for n in (1, 2, 24, 100):
        rows = sharding.with_shards(keys, shards=n).collect()
        assert all(r.shard == r.grown_shard or r.grown_shard == n for r in rows)
        more = {r.doc_id: r.shard for r in sharding.with_shards(keys, shards=n + 1).collect()}
        assert all(more[r.doc_id] == r.grown_shard for r in rows)
        moved = sum(r.grown_shard == n for r in rows)
        assert abs(moved - 2000 / (n + 1)) < 5 * (2000 / (n + 1)) ** 0.5 + 1


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert ids(out) == GIVEN
    rows = out.collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    unharmed(docs, mixed)


def test_decontamination(docs, none, benchmark):
    rows = winnowing.digest(docs, benchmark).collect()
    assert ids(winnowing.digest(docs, benchmark)) == GIVEN
    told = {r.doc_id: r for r in rows}
    assert told[1].contaminated and told[1].items == ["", "1"]
    assert told[None].items == ["4"] and told[None].n_hit == 1
    assert not told[5].contaminated and told[5].n_words == 160_000
    assert told[2].n_words == told[3].n_words == 0
    assert winnowing.digest(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert winnowing.digest(none, benchmark).count() == 0
    kept = winnowing.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    unharmed(docs, kept)


def test_decontamination_in_passes(docs, benchmark):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(winnowing.digest(docs, benchmark, index_rows=2)) == key(winnowing.digest(docs, benchmark))


def test_near_duplicates(docs, none):
    out = simhash.group_fingerprints(docs)
    assert ids(out) == GIVEN
    told = {r.doc_id: r for r in out.collect()}
    assert told[2].fingerprint == "0" * 16 and told[2].component_id == told[3].component_id == told[4].component_id == 2
    assert simhash.group_fingerprints(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    unharmed(docs, kept)
    assert ids(kept) == [(False, 0), (True, 1), (True, 2), (True, 5), (True, 6)]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_pii(docs, none):
    out = pii.digest(docs)
    assert ids(out) == GIVEN
    assert pii.digest(none).count() == 0
    assert pii.redact(docs).columns == docs.columns
    unharmed(docs, pii.redact(docs))


def test_quality(docs, none, labels):
    model = quality.train(docs, labels, metadata=["n_chars"])
    out = quality.score(docs, model, metadata=["n_chars"])
    assert ids(out) == GIVEN and all(0 <= r.score <= 1 for r in out.collect())
    unharmed(docs, out, ["score"])
    empty = quality.train(docs, labels.limit(0), metadata=["n_chars"])
    assert {round(r.score, 1) for r in quality.score(docs, empty, metadata=["n_chars"]).collect()} <= {0.4, 0.5, 0.6}
    assert quality.score(none, model, metadata=["n_chars"]).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b<p>c" + "<div>" * 3000), (3, "u", "plain"), (None, "u", "<script>x</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    out = {(r.page_id, r.text, r.n_chars) for r in tagpaths.extract(pages).collect()}
    assert out == {(1, "", 0), (2, "", 0), (3, "a & b\nc", 7), (3, "plain", 5), (None, "", 0)}
    assert tagpaths.extract(pages.limit(0)).count() == 0


def test_tokens(docs, none):
    out = tokencount.count_tokens(docs, VOCABULARY)
    assert ids(out) == GIVEN
    told = {r.doc_id: r.n_tokens for r in out.collect()}
    assert told[2] == told[3] == 0 and told[5] > 100_000
    assert tokencount.count_tokens(none, VOCABULARY).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (100, [1.0]), (8, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    out = annsearch.nearest(df, queries=F.col("vec_id") % 50 == 0, top=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 50), (0, 3, None), (50, 1, 0), (50, 2, 1), (50, 3, None), (100, 1, 8)]
    assert annsearch.nearest(df.limit(0)).count() == 0


def test_hot_keys(spark):
    """A third of all rows with one key, and some of them equal: slots stay gapless, targets are met."""
    rows = [(None, "one two three", "a")] * 300 + [(None, "w " * (i % 7 + 1), "a") for i in range(300)] + [(i, "x y z", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = sharding.assign_shards(df, shards=3, ranges=4).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len(placed) == 900
    mixed = mixing.mix(df).collect()
    assert len(mixed) == 900
    for source in "ab":
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
        assert {r.epochs - r.whole for r in own} <= {0, 1}


def test_ranges_hold_no_large_part(spark):
    """With weights far from 1 no range of the exponential key holds more than a hundredth of a source."""
    for w in (0.001, 1.0, 1000.0):
        rows = spark.range(20_000).select(mixing.exponential_key(F.col("id"), F.lit(w)).alias("e"))
        parts = rows.groupBy(F.floor(F.log2("e") * F.lit(mixing.RANGES))).count()
        assert parts.agg(F.max("count")).first()[0] < 200


def test_folder_of_checkpoints(spark):
    """On a cluster the shared folder must be named."""
    from tickloom.llm import common

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.materialize(type("Frame", (), {"sparkSession": Session}))
