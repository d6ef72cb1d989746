"""Quality scores by a factorisation machine.

Features: hashed words (length-normalised log counts), structure statistics of the text and
metadata columns. The machine adds to the linear score all pairwise interactions, of low rank;
with the identity sum_ij <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum v_i^2 x_i^2) / 2 that
takes time linear in the features present.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, packed, quoted, schema_with, text_within, unpacked
from tickloom.llm.textbytes import SPACED, Words, byte_table, slices

BUCKETS = 1 << 14
#: Text whose features are in memory at once.
PART_BYTES = 2 << 20
STATS = 20
CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "plain": np.isin(np.arange(256), list(b".,;:!?'\"()-")),
    "space": np.isin(np.arange(256), [32, *range(9, 14)]),
    "line": np.arange(256) == 10,
    "odd": np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "bang": np.isin(np.arange(256), list(b"!?")),
}
_AS_IS = byte_table(b"")


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray  # of the statistics, for scaling
    scale: np.ndarray
    buckets: int
    n_meta: int


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _statistics(raw: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> list[float]:
    n, m = len(raw), len(hashes)
    share = [_ratio(float(table[raw].sum()), n) for table in CLASSES.values()]
    unique = np.unique(hashes, return_counts=True)[1] if m else np.zeros(0)
    same = float((hashes[1:] == hashes[:-1]).sum()) if m > 1 else 0.0
    pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1] if m > 1 else np.zeros(0, np.uint64)
    lines = np.diff(np.concatenate([[-1], np.flatnonzero(raw == 10), [n]])) - 1
    return [
        *share,
        float((raw >= 128).sum()) / max(n, 1),
        np.log1p(n),
        np.log1p(m),
        _ratio(float(lengths.sum()), m),
        float(lengths.std()) if m else 0.0,
        float(lengths.max()) if m else 0.0,
        _ratio(len(unique), m),
        _ratio(float(unique.max()) if m else 0.0, m),
        _ratio(same, m - 1),
        _ratio(len(np.unique(pairs)), m - 1),
        np.log1p(len(lines)),
        _ratio(float(lines.std()), float(lines.mean())) if n else 0.0,
        1.0 if m == 0 else 0.0,
    ]


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    """(word buckets, values, statistics) of each text, in order. Words are runs of other than white space, in lower case."""
    for lo, hi, data, offsets in slices(column):
        words = Words(data, offsets, SPACED)
        lengths = (words.end - words.begin).astype(np.float64)
        for r in range(hi - lo):
            a, b = words.first[r], words.first[r + 1]
            own = words.hash[a:b]
            ids, counts = np.unique(own & np.uint64(buckets - 1), return_counts=True)
            values = np.log1p(counts)
            norm = np.sqrt((values**2).sum())
            yield ids.astype(np.int32), (values / norm if norm else values).astype(np.float32), _statistics(data[offsets[r] : offsets[r + 1]], own, lengths[a:b])


def _meta(metadata: Sequence[str]) -> Column:
    return F.array(*[F.log1p(F.greatest(F.coalesce(quoted(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in metadata]).cast("array<double>")


def _few(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of its texts, so that features take memory by the part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class _Sparse:
    """Rows of features: indices and values one after the other, and where each row starts."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray]):
        self.starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.values = np.concatenate(values) if values else np.zeros(0, np.float32)


def _assemble(words: list, stats: np.ndarray, model: FactorisationMachine) -> _Sparse:
    """Words, then the scaled statistics; every row has the latter, so none is empty."""
    scaled = np.clip((stats - model.mean) / model.scale, -4, 4).astype(np.float32)
    own = np.arange(model.buckets, model.buckets + stats.shape[1], dtype=np.int32)
    return _Sparse([np.concatenate([ids, own]) for ids, _ in words], [np.concatenate([v, s]) for (_, v), s in zip(words, scaled)])


def _margin(model: FactorisationMachine, x: _Sparse) -> tuple[np.ndarray, np.ndarray]:
    """The machine's score of each row, and sum(v x) of each row."""
    v = model.factors[x.ids] * x.values[:, None]
    total = np.add.reduceat(v, x.starts[:-1], axis=0)
    squares = np.add.reduceat(v * v, x.starts[:-1], axis=0)
    linear = np.add.reduceat(model.linear[x.ids] * x.values, x.starts[:-1])
    return model.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(words: list, stats: np.ndarray, labels: np.ndarray, *, rank: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, batch: int = 256, buckets: int = BUCKETS, seed: int = 0) -> FactorisationMachine:
    """Minimise the logistic loss by Adagrad over mini-batches."""
    rng = np.random.default_rng(seed)
    size, n = buckets + stats.shape[1], len(labels)
    scale = stats.std(axis=0) if n else np.ones(stats.shape[1])
    mean = stats.mean(axis=0) if n else np.zeros(stats.shape[1])
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if n else 0.5
    linear, factors = np.zeros(size, np.float32), (rng.standard_normal((size, rank)) * 0.02).astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    model = lambda: FactorisationMachine(bias, linear, factors, mean, np.where(scale > 1e-9, scale, 1.0), buckets, stats.shape[1] - STATS)
    g_bias, g_linear, g_factors = 1e-3, np.full(size, 1e-3, np.float32), np.full((size, rank), 1e-3, np.float32)
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            x = _assemble([words[i] for i in rows], stats[rows], model())
            z, total = _margin(model(), x)
            error = ((_sigmoid(z) - labels[rows]) / len(rows)).astype(np.float32)
            each = np.repeat(np.arange(len(rows)), np.diff(x.starts))
            sort = np.argsort(x.ids, kind="stable")
            ids, starts = np.unique(x.ids[sort], return_index=True)
            pull = error[each] * x.values
            d_linear = np.add.reduceat(pull[sort], starts) + decay * linear[ids]
            vx = factors[x.ids] * x.values[:, None]
            d_factors = np.add.reduceat((pull[:, None] * (total[each] - vx))[sort], starts, axis=0) + decay * factors[ids]
            g_bias += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / g_bias**0.5
            g_linear[ids] += d_linear**2
            linear[ids] -= rate * d_linear / np.sqrt(g_linear[ids])
            g_factors[ids] += d_factors**2
            factors[ids] -= rate * d_factors / np.sqrt(g_factors[ids])
    return model()


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    metadata: Sequence[str] = (),
    where: Column | None = None,
    most_rows: int = 12_000,
    most_features: int = 1 << 24,
    **options,
) -> FactorisationMachine:
    """Fit on at most `most_rows` labelled rows, drawn by a hash of the key; only their features reach the driver.

    Of these rows, in the order of key and text, as many are learned from as have `most_features` features in all
    (8 bytes each on the driver).

    `where` may use the column k (the key). Null labels and keys don't count; of several labels
    of a key the mean counts. If documents repeat a key, all of them are learned from as far as
    `most_rows` goes, in the order of key and text. Without labelled rows every score is 0.5.
    """
    marked = labels.select(quoted(key).alias("k"), quoted(label).cast("double").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    marked = marked.filter(F.lit(True) if where is None else where).groupBy("k").agg(F.avg("y").alias("y"))
    drawn = marked.orderBy(F.xxhash64(F.lit("quality"), "k"), "k").limit(most_rows)
    slim = docs.select(quoted(text).cast("string").alias("t"), _meta(metadata).alias("meta"), quoted(key).alias("own"))
    rows = slim.join(F.broadcast(drawn), F.col("own") == F.col("k")).select("t", "meta", F.col("k").cast("string").alias("k"), "y", F.xxhash64("t").alias("h"))  # at most most_rows keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few(whole, whole.column(0))):
            told = list(features(batch.column(0)))
            stats = [[*s, *m.as_py()] for (_, _, s), m in zip(told, batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in told], pa.list_(pa.int32())), pa.array([v for _, v, _ in told], pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float64())), *batch.columns[2:]],
                ["ids", "vals", "stats", "k", "y", "h"],
            )

    told = rows.mapInArrow(run, "ids array<int>, vals array<float>, stats array<double>, k string, y double, h long")
    told = materialize(told.select("*", F.size("ids").alias("n")))
    order = ["k", "h", "n"]
    rows_there, features_there = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows_there > most_rows or features_there > most_features:
        sizes = told.select(*order).orderBy(*order).limit(most_rows).toArrow()["n"].to_numpy()
        fitting = int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), most_features, "right"))
        told = told.orderBy(*order).limit(max(1, fitting))
    model = fit(*_gathered(told, order, STATS + len(metadata)), **options)
    pa.default_memory_pool().release_unused()  # else the driver keeps the room of the training rows
    return model


def _gathered(told: DataFrame, order: Sequence[str], width: int) -> tuple[list, np.ndarray, np.ndarray]:
    """What fit() takes, in that order of rows. Words are views of what Arrow has read: the rows are on the driver once."""
    table = told.toArrow()
    # sorted here: a sort by Spark would hold the rows as objects on the driver
    place = pc.sort_indices(table.select(order), sort_keys=[(c, "ascending") for c in order]).to_numpy()
    words, stats = [], [np.zeros((0, width))]
    for batch in table.to_batches():
        ids, values, own = (batch[c].flatten().to_numpy() for c in ("ids", "vals", "stats"))
        ends = np.cumsum(pc.list_value_length(batch["ids"]).to_numpy())
        words += [(ids[a:b], values[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        stats.append(own.reshape(-1, width))
    return [words[i] for i in place], np.concatenate(stats)[place], table["y"].to_numpy()[place]


def score(df: DataFrame, model: FactorisationMachine, *, text: str = "text", metadata: Sequence[str] = (), into: str = "score") -> DataFrame:
    """df with the machine's score of the whole text, 0 to 1.

    A null text scores as an empty one, a null or negative of the metadata as 0; equal rows
    score equally. A column of the name `into` is replaced, all others are kept whatever their
    names. No rows in, no rows out.
    """
    keep = [c for c in df.columns if c != into]
    shared = df.sparkSession.sparkContext.broadcast(vars(model))
    texts, extra = text_within(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorisationMachine(**shared.value)
        for batch in (part for whole in batches for part in _few(whole, texts(whole))):
            told = list(features(texts(batch), own.buckets))
            if told:
                stats = np.array([[*s, *m.as_py()] for (_, _, s), m in zip(told, batch.column(1))])
                z, _ = _margin(own, _assemble([(i, v) for i, v, _ in told], stats, own))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z).astype(np.float64))], ["row", "told"])

    slim = df.select(packed(keep).alias("row"), _meta(metadata).alias("meta"), *extra)
    out = slim.mapInArrow(run, schema_with(slim, "row", "told double"))
    return out.select(*unpacked(keep), F.col("told").alias(into))
