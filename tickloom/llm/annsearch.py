"""Approximate nearest neighbours with score-aware (anisotropic) product quantisation.

Vectors are scaled to length 1, so the inner product is the cosine. What a coarse centre leaves
over is scaled to length 1 (its norm is kept) and cut into subspaces of two dimensions with 16
codewords each, four bits. The loss weighs the part of the error that is parallel to the vector
more than the rest, as that part changes the products of the queries that the vector answers.

Every row is encoded once and kept with its cell, that is its nearest centre. A query goes to
the cells with the largest products; how many is measured on the sample, so that they hold its
neighbours. Cells are dealt to blocks by a hash, a block and a part of its queries meet in a
task: table entries are summed over the codes, and the best rows of the block are scored
exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, quoted, schema_with

WORDS = 16
SUB = 2


@dataclass(frozen=True)
class Codebook:
    dim: int
    coarse: np.ndarray  # centres x dim
    words: np.ndarray  # subspaces x WORDS x SUB
    eta: float  # weight of the parallel error over that of the rest


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))


def _split(x: np.ndarray) -> np.ndarray:
    return _padded(x).reshape(len(x), -1, SUB)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


def _residuals(unit: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, norm of the rest, the rest scaled to length 1) of each row."""
    cell = _nearest(unit, coarse)
    rest = unit - coarse[cell]
    norm = np.linalg.norm(rest, axis=1)
    return cell, norm, rest / np.where(norm > 1e-12, norm, 1.0)[:, None]


def _encode(rest: np.ndarray, unit: np.ndarray, words: np.ndarray, eta: float, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes that lower |e|^2 + (eta - 1) (e . x)^2 by turns over the subspaces; also e . x of each subspace."""
    u, d = _split(rest), _split(unit)
    n, m = u.shape[:2]
    codes = np.empty((n, m), np.uint8)
    along = np.empty((n, m))
    flat, par = np.empty((m, n, WORDS)), np.empty((m, n, WORDS))
    for j in range(m):
        error = u[:, j, None, :] - words[j][None, :, :]
        flat[j], par[j] = (error**2).sum(axis=2), (error * d[:, j, None, :]).sum(axis=2)
        codes[:, j] = flat[j].argmin(axis=1)
        along[:, j] = par[j][np.arange(n), codes[:, j]]
    total = along.sum(axis=1)
    for _ in range(rounds):
        for j in range(m):
            others = total - along[:, j]
            best = (flat[j] + (eta - 1) * (others[:, None] + par[j]) ** 2).argmin(axis=1)
            codes[:, j] = best
            along[:, j] = par[j][np.arange(n), best]
            total = others + along[:, j]
    return codes, along


def fit(vectors: np.ndarray, *, centres: int = 64, threshold: float = 0.2, rounds: int = 8, seed: int = 0) -> Codebook:
    """Coarse centres by k-means, then codewords by turns of encoding and weighted least squares."""
    rng = np.random.default_rng(seed)
    dim = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    coarse = unit[rng.choice(len(unit), min(centres, len(unit)), replace=False)].copy()
    for _ in range(rounds):
        cell = _nearest(unit, coarse)
        for c in np.unique(cell):
            coarse[c] = unit[cell == c].mean(axis=0)
    _, _, rest = _residuals(unit, coarse)
    u, d = _split(rest), _split(unit)
    m = u.shape[1]
    words = np.stack([u[rng.choice(len(u), WORDS, replace=len(u) < WORDS), j] for j in range(m)])
    for _ in range(rounds):
        codes, along = _encode(rest, unit, words, eta, rounds=1)
        total = along.sum(axis=1)
        for j in range(m):
            others = total - along[:, j]
            for w in range(WORDS):
                own = codes[:, j] == w
                if own.sum() < 2:
                    continue
                dj, uj = d[own, j], u[own, j]
                left = own.sum() * np.eye(SUB) + (eta - 1) * dj.T @ dj
                right = uj.sum(axis=0) + (eta - 1) * (dj * ((dj * uj).sum(axis=1) + others[own])[:, None]).sum(axis=0)
                words[j, w] = np.linalg.solve(left, right)
    return Codebook(dim, coarse, words, eta)


def valid_vector(vector: Column) -> Column:
    """Whether the vector is not null, not zero, and holds neither nulls nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors, all of one length, as doubles."""
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed_codes(rest: np.ndarray, unit: np.ndarray, book: Codebook) -> np.ndarray:
    """Two codes of four bits to a byte."""
    codes, _ = _encode(rest, unit, book.words, book.eta)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] * WORDS + codes[:, 1::2]


def cells_needed(unit: np.ndarray, coarse: np.ndarray, *, top: int, recall: float, asked: int = 256) -> int:
    """How many cells, best product first, hold that share of the `top` neighbours of the sample's vectors in the sample."""
    some = unit[:asked]
    product = some @ unit.T
    product[np.arange(len(some)), np.arange(len(some))] = -np.inf
    best = np.argsort(-product, axis=1)[:, : min(top, len(unit) - 1)]
    place = np.argsort(np.argsort(-(some @ coarse.T), axis=1), axis=1)
    needed = np.take_along_axis(place, _nearest(unit, coarse)[best], axis=1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1 if len(needed) else 1


def _best_of_block(ids: list, x: np.ndarray, scale: np.ndarray, codes: np.ndarray, centre: np.ndarray, book: Codebook, queries: np.ndarray, query_ids: np.ndarray, top: int, depth: int, at_once: int = 64) -> Iterator[tuple[int, int | None, float]]:
    """Of one block, each query's `top` of the rows that the table scan ranks among the first `depth` distinct vectors."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    x, ids = x[order], [ids[i] for i in order]
    _, first, of = np.unique(x.view(np.dtype((np.void, x.strides[0]))).ravel(), return_index=True, return_inverse=True)
    by_vector = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[by_vector], np.arange(len(first)))
    ends = np.append(begins[1:], len(of))
    rows, scale, pairs = x[first], scale[order][first], codes[order][first]
    norms = np.linalg.norm(rows, axis=1)
    q_norms = np.linalg.norm(queries, axis=1)
    for lo in range(0, len(queries), at_once):
        q = queries[lo : lo + at_once] / q_norms[lo : lo + at_once, None]
        table = np.einsum("qms,mws->qmw", _split(q), book.words)
        if table.shape[1] % 2:
            table = np.pad(table, ((0, 0), (0, 1), (0, 0)))
        double = (table[:, 0::2, :, None] + table[:, 1::2, None, :]).reshape(len(q), -1, WORDS * WORDS).astype(np.float32)
        sums = np.zeros((len(q), len(rows)), np.float32)
        for j in range(pairs.shape[1]):
            sums += double[:, j, pairs[:, j]]
        sums = (q @ centre)[:, None] + scale * sums
        for k in range(len(q)):
            chosen = np.arange(len(rows)) if len(rows) <= depth else np.argpartition(-sums[k], depth)[:depth]
            score = (rows[chosen] * queries[lo + k]).sum(axis=1) / (norms[chosen] * q_norms[lo + k])  # row by row: equal vectors score equally in every block
            own, found = int(query_ids[lo + k]), []
            level = np.sort(score)[-min(top + 1, len(score))]
            for c in np.flatnonzero(score >= level):
                g = chosen[c]
                members = [ids[i] for i in by_vector[begins[g] : min(ends[g], begins[g] + top + 1)]]
                found += [(-float(score[c]), i is None, i or 0, i) for i in members if i != own]
            for s, _, _, i in sorted(found, key=lambda f: f[:3])[:top]:
                yield own, i, -s


def _search(rows: DataFrame, dim: int, number: int, *, top: int, depth: int, sample: int, recall: float, block_rows: int, block_queries: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score) of the rows (id, v, asks), all of one length: the best of each block."""
    spark = rows.sparkSession
    drawn = _matrix(rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "v").limit(sample).select("v").toArrow()["v"])
    centres = int(max(1, min(number**0.5 / 4, len(drawn) / 40)))
    book = fit(drawn, centres=centres, seed=seed)
    probes = cells_needed(drawn / np.linalg.norm(drawn, axis=1)[:, None], book.coarse, top=top, recall=recall)
    shared = spark.sparkContext.broadcast(vars(book))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebook(**shared.value)
        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                cell, scale, rest = _residuals(unit, own.coarse)
                codes = [c.tobytes() for c in _packed_codes(rest, unit, own)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(scale), pa.array(codes, pa.binary())], [*batch.schema.names, "cell", "scale", "codes"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebook(**shared.value)
        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                cells = np.argsort(-(x @ own.coarse.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    kept = materialize(rows.mapInArrow(encode, schema_with(rows, "id", "v array<double>, asks boolean, cell int, scale double, codes binary")))
    asked = kept.filter(F.col("asks") & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    sent = asked.mapInArrow(probe, "id long, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))
    sent = materialize(sent)
    there, wanted = np.zeros(centres, np.int64), np.zeros(centres, np.int64)
    for table, out in ((kept, there), (sent, wanted)):
        for r in table.groupBy("cell").count().collect():  # a row a cell
            out[r["cell"]] = r["count"]
    parts = lambda n, size: F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-n // size))])[F.col("cell")]
    blocks, turns = parts(there, block_rows), parts(wanted, block_queries)
    left = kept.withColumns({"block": F.pmod(F.xxhash64("id", "v"), blocks).cast("int"), "turn": F.explode(F.sequence(F.lit(0), turns - 1))})
    right = sent.withColumns({"turn": F.pmod(F.xxhash64("id"), turns).cast("int"), "block": F.explode(F.sequence(F.lit(0), blocks - 1))})
    key = ["cell", "block", "turn"]

    def search(held: pa.Table, asking: pa.Table) -> pa.Table:
        own = Codebook(**shared.value)
        told: list = []
        if len(held) and len(asking):
            codes = np.array([np.frombuffer(c.as_buffer(), np.uint8) for c in held["codes"]])
            centre = own.coarse[held["cell"][0].as_py()]
            told = list(_best_of_block(held["id"].to_pylist(), _matrix(held["v"]), held["scale"].to_numpy(), codes, centre, own, _matrix(asking["v"]), asking["id"].to_numpy(), top, depth))
        q, i, s = zip(*told) if told else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    slim = left.select(*key, "id", "v", "scale", "codes")
    return slim.groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(
    df: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    queries: Column | None = None,
    top: int = 5,
    depth: int = 256,
    sample: int = 10_000,
    recall: float = 0.99,
    block_rows: int = 8192,
    block_queries: int = 8192,
    seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` nearest other rows by cosine, ties to the smaller id.

    `queries` is a predicate on df. Rows that share the query's id are its own and no
    candidates; of queries with one id the smallest vector counts; a null id is a candidate
    only. Invalid vectors (see valid_vector) take no part; vectors of different lengths are
    spaces of their own. No valid rows, no result. Other columns are not looked at.

    Codebook and cells are fitted on `sample` rows at most, drawn by a hash; the number of cells
    grows with the root of the rows as far as the sample carries. Every row is encoded, kept,
    and scanned by the queries that come to its cell; these go to so many cells as hold the
    share `recall` of the sample's neighbours. Blocks have about `block_rows` rows and
    `block_queries` queries and each gives `depth` distinct vectors to exact scoring. Blocks go
    by a hash of id and vector, so results do not hang on partitions or batches.
    """
    rows = df.select(quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"), (F.lit(True) if queries is None else queries).alias("asks"))
    rows = rows.filter(valid_vector(F.col("v")))
    found = df.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for dim, number in sorted(rows.groupBy(F.size("v")).count().collect()):  # a row for each length of vectors
        found = found.unionByName(_search(rows.filter(F.size("v") == dim), dim, number, top=top, depth=depth, sample=sample, recall=recall, block_rows=block_rows, block_queries=block_queries, seed=seed))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
