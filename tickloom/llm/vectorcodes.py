"""Vector codes: each vector's parts as the numbers of their nearest codebook entries, exactly.

Components become integers, floor(scale * x). The nearest entry of a part is found by a float32
matrix product: with n components the product's rounding error is at most gamma(n + 2) times the
two norms, whatever the order of summation, so every score has an interval that surely holds its
true value. Entries whose interval overlaps the best one's are evaluated again in int64, ties go
to the smaller index. Parts too large for int64 distances take Python integers; sums travel in
limbs of 40 bits, so nothing ever overflows or is rounded.

Codebooks are fitted by Lloyd's rounds over all vectors: every task sums its parts by entry,
Spark adds the sums up, and the driver gets one row for each entry and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tickloom.llm.common import materialize, quoted

#: Components below this bound are exact as float32, and the squared differences of up to 8191 of them sum within int64.
SMALL = 1 << 24
_LIMB = 40
_UNIT = 2.0**-24
#: Vectors screened at once.
AT_ONCE = 1 << 13
#: As many labels are joined by broadcast; beyond, the totals are dealt out with the rows.
FEW_LABELS = 100_000
SALTS = 64


@dataclass(frozen=True)
class Codebooks:
    """entries[p][j] is entry j of part p: integers, as int64 or as Python's where they pass that."""

    entries: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def sha256(self) -> str:
        """Over all entries' decimal components by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for row in part.tolist() for x in row).encode()).hexdigest()


def integers(vectors: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their components as integers): int64, or Python integers if one passes SMALL. Rows that are null or hold null or non-finite components don't count; with a width, short rows end in zeros."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(vectors), pa.float64())
    bad = ~np.isfinite(np.asarray(pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False), np.float64))
    owner = np.repeat(np.arange(len(vectors)), lengths)
    fine = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    fine = fine & (np.bincount(owner[bad], minlength=len(vectors)) == 0)
    rows = np.flatnonzero(fine)
    width = int(lengths[rows].max(initial=0)) if width is None else width
    numbers = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    made = np.zeros((len(vectors), width))
    made[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.where(bad, 0.0, numbers)
    made = made[rows]
    with np.errstate(over="ignore"):
        scaled = np.floor(made * scale)
    if np.abs(scaled).max(initial=0) < SMALL:
        return rows, scaled.astype(np.int64)
    exact = np.empty(made.shape, object)
    for at, x in np.ndenumerate(made):
        exact[at] = math.floor(x * scale) if abs(x) < 1e280 else int(x) * scale
    return rows, exact


def _gamma(n: int) -> float:
    return (n + 2) * _UNIT / (1 - (n + 2) * _UNIT) * 1.001


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, smaller first among equals; squared distance) of each row, exactly."""
    wide = parts.dtype == object or entries.dtype == object or parts.shape[1] * (2 * SMALL) ** 2 >= 1 << 63
    if not wide:
        return _screened(parts, entries)
    # rows and entries that fit go the short way; the others are compared in Python's integers
    small_rows = np.array([max(map(abs, r), default=0) < SMALL for r in parts.tolist()], bool) if parts.dtype == object else np.ones(len(parts), bool)
    index, distance = np.zeros(len(parts), np.int64), np.empty(len(parts), object)
    exact = entries.astype(object)
    sizes = [max(map(abs, e), default=0) for e in entries.tolist()]
    fit = np.flatnonzero([s < SMALL for s in sizes])
    largest = [(j, sizes[j]) for j in range(len(sizes)) if sizes[j] >= SMALL]
    if len(fit) and small_rows.any() and parts.shape[1] * (2 * SMALL) ** 2 < 1 << 63:
        at, d = _screened(parts[small_rows].astype(np.int64), exact[fit].astype(np.int64))
        index[small_rows], distance[small_rows] = fit[at], d.astype(object)
        for i in np.flatnonzero(small_rows):
            # no component of a small row comes nearer than this to an entry's largest
            for j, size in largest:
                if (size - SMALL) ** 2 <= distance[i]:
                    d = int(((parts[i].astype(object) - exact[j]) ** 2).sum())
                    if (d, j) < (distance[i], index[i]):
                        index[i], distance[i] = j, d
        rest = np.flatnonzero(~small_rows)
    else:
        rest = np.arange(len(parts))
    for i in rest:
        d = ((exact - parts[i].astype(object)) ** 2).sum(axis=1).tolist() if parts.shape[1] else [0] * len(exact)
        index[i] = min(range(len(d)), key=d.__getitem__)
        distance[i] = d[index[i]]
    return index, distance


def _screened(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = parts.shape[1]
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    codes = entries.astype(np.float32).T
    squares = (entries * entries).sum(axis=1).astype(np.float64)
    norms = np.sqrt(squares) * (1 + 1e-9)
    for lo in range(0, len(parts), AT_ONCE):
        x = parts[lo : lo + AT_ONCE]
        score = squares - 2.0 * (x.astype(np.float32) @ codes).astype(np.float64)
        length = np.sqrt((x * x).sum(axis=1).astype(np.float64)) * (1 + 1e-9)
        # twice the product's error, and the rounding of the squares, the product and their difference in double precision
        slack = length[:, None] * norms * (2 * _gamma(n) + 2.0**-48) + squares * 2.0**-48
        best = (score + slack).min(axis=1)
        row, entry = np.nonzero(score - slack <= best[:, None])
        apart = x[row] - entries[entry]
        exact = np.einsum("ij,ij->i", apart, apart)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(exact, first) if len(first) else exact
        # pairs lie by row and entry: of those with the least distance the first is the smallest index
        equal = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(row)))))
        _, at = np.unique(row[equal], return_index=True)
        index[lo : lo + AT_ONCE], distance[lo : lo + AT_ONCE] = entry[equal[at]], least
    return index, distance


def _cut(components: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(components, parts, axis=1)


def _sums(components: np.ndarray, books: Codebooks, held: dict[tuple[int, int], list]) -> None:
    """Add the parts of each entry up: held[part, entry] = [count, sums as Python's integers]."""
    for p, (x, entries) in enumerate(zip(_cut(components, len(books.entries)), books.entries)):
        index, _ = nearest(x, entries)
        order = np.argsort(index, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], index[order][1:] != index[order][:-1]])) if len(index) else []
        for j, rows in zip(index[order][first].tolist() if len(index) else [], np.split(order, first[1:] if len(index) else [])):
            total = x[rows].sum(axis=0).tolist()
            have = held.setdefault((p, j), [0, [0] * len(total)])
            have[0] += len(rows)
            have[1] = [a + b for a, b in zip(have[1], total)]


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """x as limbs (place, value), the last one signed."""
    place = 0
    while not -(1 << _LIMB) < x < 1 << _LIMB:
        yield place, x & ((1 << _LIMB) - 1)
        x, place = x >> _LIMB, place + 1
    yield place, x


def _of(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    return vectors.select(quoted(id_col).alias("id"), quoted(vector).cast("array<double>").alias("v"))


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of all rows whose vector counts (see integers()); None if there are none.

    Part p's codebook starts as that part of the rows with the smallest ids (ties and null ids,
    which come last, by vector). Each round replaces an entry by floor(sum / count) of the parts
    nearest to it; unused entries stay. Vectors of unlike lengths, or lengths that `parts` does
    not divide, are filled up with zeros to one width.
    """
    slim = _of(vectors, id_col, vector)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = slim.filter(F.col("v").isNotNull() & finite)
    longest = whole.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(parts, -(-longest // parts) * parts)
    start = whole.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    _, first = integers(start, scale, width)
    books = Codebooks(_cut(first, parts), scale)
    for _ in range(rounds):
        made = whole.mapInArrow(_summing(books, width), "part int, entry int, at int, limb int, total bigint")
        rows = made.groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).toArrow().to_pylist()
        sums: dict[tuple[int, int, int], int] = {}
        for r in rows:
            key = r["part"], r["entry"], r["at"]
            sums[key] = sums.get(key, 0) + (int(r["total"]) << _LIMB * r["limb"])
        books = Codebooks([_replaced(e, p, sums) for p, e in enumerate(books.entries)], scale)
    return books


def _replaced(entries: np.ndarray, part: int, sums: dict[tuple[int, int, int], int]) -> np.ndarray:
    now = [[sums[part, j, i] // sums[part, j, -1] for i in range(len(row))] if (part, j, -1) in sums else row for j, row in enumerate(entries.tolist())]
    return np.array(now, np.int64 if max((abs(x) for row in now for x in row), default=0) < SMALL else object)


def _summing(books: Codebooks, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, components = integers(batch["v"], books.scale, width)
            _sums(components, books, held)
        out = [(p, j, at, limb, x) for (p, j), (count, total) in held.items() for at, value in ((-1, count), *enumerate(total)) for limb, x in _limbs(value)]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "at", "limb", "total"])

    return run


def encode(vectors: DataFrame, books: Codebooks | None, *, id_col: str = "vec_id", vector: str = "embedding", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns of `also`, code, error) of the rows whose vector counts: the entries' numbers, two hex digits a part (more for larger codebooks), and the sum of the squared distances, null if it passes a long."""
    kinds = vectors.schema
    slim = vectors.select(quoted(id_col).alias("id"), quoted(vector).cast("array<double>").alias("v"), *[quoted(c).alias(f"also{i}") for i, c in enumerate(also)])
    kept = ["id", *[f"also{i}" for i in range(len(also))]]
    schema = StructType([StructField(n, kinds[c].dataType) for n, c in zip(kept, (id_col, *also))] + StructType.fromDDL("code string, error bigint").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, components = integers(batch["v"], books.scale, books.width * len(books.entries))
            digits = max(2, len(f"{max(len(e) for e in books.entries) - 1:x}"))
            names = np.array([f"{j:0{digits}x}" for j in range(max(len(e) for e in books.entries))], object)
            fits = components.shape[1] * (2 * SMALL) ** 2 < 1 << 63
            code, error = np.full(len(rows), "", object), np.zeros(len(rows), np.int64 if fits else object)
            for x, entries in zip(_cut(components, len(books.entries)), books.entries):
                index, distance = nearest(x, entries)
                code, error = code + names[index], error + distance
            told = pa.array([int(e) if e < 1 << 63 else None for e in error] if error.dtype == object else error, pa.int64())
            yield pa.record_batch([*[batch[n].take(pa.array(rows)) for n in kept], pa.array(code, pa.string()), told], [*kept, "code", "error"])

    made = slim.limit(0).select(*kept, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")) if books is None else slim.mapInArrow(run, schema)
    return made.select(F.col("id").alias(id_col), *[F.col(f"also{i}").alias(c) for i, c in enumerate(also)], "code", "error")


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The vectors that codes stand for, as doubles."""
    digits = len(codes[0]) // len(books.entries) if codes else 2
    number = [[int(c[p * digits : (p + 1) * digits], 16) for p in range(len(books.entries))] for c in codes]
    return np.array([np.concatenate([books.entries[p][j] for p, j in enumerate(row)]) for row in number], np.float64) / books.scale


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every row whose vector counts.

    label_error sums the errors of equal labels, nulls together; null if it passes a long or one
    of them does. Rows that repeat are coded again and count again; null ids stay. No row that
    counts: no rows. Other columns are not looked at.
    """
    books = fit(vectors, id_col=id_col, vector=vector, parts=parts, entries=entries, rounds=rounds, scale=scale)
    coded = encode(vectors.select(quoted(id_col).alias("id"), quoted(vector).alias("v"), quoted(label).alias("label")), books, id_col="id", vector="v", also=("label",))
    coded = materialize(coded)
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (wide <= F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.when(fits, wide).cast("long").alias("label_error"))
    totals = materialize(totals)
    if totals.count() <= FEW_LABELS:
        met = coded.join(F.broadcast(totals), coded["label"].eqNullSafe(totals["label"]), "left").drop(totals["label"])
    else:
        salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        met = rows.join(salted, rows["label"].eqNullSafe(salted["label"]) & (rows["salt"] == salted["salt"]), "left").drop(salted["label"]).drop("salt")
    sha = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return met.select(F.col("id").alias(id_col), F.col("label").alias(label), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
