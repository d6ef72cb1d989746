"""SimHash near duplicates with pigeonring filtering.

A fingerprint is cut into segments on a ring. If two fingerprints differ in at most t bits of
m segments, then from some segment on every chain of l consecutive segments differs in at most
l * t / m bits. Candidates are joined on the start of such a chain and must satisfy the longer
chains before the full Hamming check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, packed, quoted, unpacked
from tickloom.llm.components import connected_components
from tickloom.llm.textbytes import SPACED, Words, mix64, slices

BITS, SEGMENTS, SEGMENT_BITS = 64, 4, 16


def _majority(hashes: np.ndarray, at_once: int = 1 << 15) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), at_once):
        part = hashes[k : k + at_once]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: XXH64 of each run of `shingle` words, ASCII lower case; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = [digest(joined, seed)]
    else:
        values = [digest(joined[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :])]
    return _majority(np.array(values, dtype=">u8"))


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = [fingerprint_of(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    slim = df.select(quoted(key).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


#: Fingerprints that share a chain start and are still joined on it alone.
CROWD = 256
REST_BITS = BITS - SEGMENT_BITS - SEGMENT_BITS // 2
PIECE_BITS = REST_BITS // SEGMENTS


def _turned(x: Column, start: Column) -> Column:
    """x turned so that segment `start` of the ring is the lowest."""
    out = F.when(start == 0, x)
    for i in range(1, SEGMENTS):
        s = SEGMENT_BITS * i
        out = out.when(start == i, F.shiftrightunsigned(x, s).bitwiseOR(F.shiftleft(x, BITS - s)))
    return out


def _within(differing: Column, start: Column, max_bits: int) -> Column:
    """Whether the chains of 2 and 3 segments from `start` keep to their share of the bits, and then all segments do."""
    turned = _turned(differing, start)
    ok = F.bit_count(turned.bitwiseAND(F.lit((1 << (SEGMENT_BITS * 2)) - 1))) <= 2 * max_bits // SEGMENTS
    ok = ok & (F.bit_count(turned.bitwiseAND(F.lit((1 << (SEGMENT_BITS * 3)) - 1))) <= 3 * max_bits // SEGMENTS)
    return ok & (F.bit_count(differing) <= max_bits)


def links(fps: DataFrame, max_bits: int = 3, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints at most `max_bits` (up to 3) apart, possibly repeated.

    With 3 bits on 4 segments some segment is equal and its successor differs in at most one
    bit, so one half of the successor is equal too: the join key is a segment and a half of
    the next, 24 bits, eight rows a fingerprint. The longer chains are checked first, inside
    the join, then the full distance, so it returns links only.

    A key that more than `crowd` fingerprints share is split, not cut: of the 40 bits outside
    the key at most 3 differ, so of four pieces of 10 bits one is equal, and the key with a
    piece is the new key, four rows for one.
    """
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError("max_bits must be below the number of segments")
    keys = []
    for i in range(SEGMENTS):
        nxt = _segment(F.col("fp"), i + 1)
        for half, part in enumerate((nxt.bitwiseAND(F.lit(0xFF)), F.shiftright(nxt, 8))):
            keys.append(F.lit((2 * i + half) << 24) + _segment(F.col("fp"), i) * F.lit(256) + part)
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("chain"))
    crowded = rows.groupBy("chain").agg(F.count("*").alias("there")).filter(F.col("there") > crowd).select("chain", F.lit(True).alias("full"))
    rows = rows.join(crowded, "chain", "left")
    start, half = F.shiftright("chain", 25).cast("int"), F.shiftright("chain", 24).bitwiseAND(F.lit(1))
    # the bits outside the key, lowest first: the other half of the next segment, then the two further ones
    turned = _turned(F.col("fp"), start)
    other = F.when(half == 0, F.shiftrightunsigned(turned, SEGMENT_BITS + 8)).otherwise(F.shiftrightunsigned(turned, SEGMENT_BITS)).bitwiseAND(F.lit(0xFF))
    rest = other.bitwiseOR(F.shiftleft(F.shiftrightunsigned(turned, 2 * SEGMENT_BITS), 8))
    pieces = [F.lit((k + 1) << PIECE_BITS) + F.shiftrightunsigned(rest, PIECE_BITS * k).bitwiseAND(F.lit((1 << PIECE_BITS) - 1)) for k in range(SEGMENTS)]
    rows = rows.select("fp", "chain", F.explode(F.when(F.col("full"), F.array(*pieces)).otherwise(F.array(F.lit(0).cast("long")))).alias("piece"))
    a, b = rows.alias("a"), rows.alias("b")
    near = _within(F.col("a.fp").bitwiseXOR(F.col("b.fp")), F.shiftright(F.col("a.chain"), 25).cast("int"), max_bits)
    met = a.join(b, (F.col("a.chain") == F.col("b.chain")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.fp") < F.col("b.fp")) & near)
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def group_fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that a chain of links reaches, its own included. Equal
    fingerprints are one node, so copies cost nothing; texts without words (null, empty) share
    fingerprint zero and link like any other. A null doc_id links but is never the smallest;
    repeated rows stay.
    """
    fps = materialize(fingerprints(df, key=key, text=text, shingle=shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = connected_components(links(fps, max_bits))
    rooted = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(roots, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- near duplicates by shingle similarity -------------------------------------------------
#
# First the method itself: `fp` is a SimHash of 64 bits over the set of shingles, chains of its
# ring link fingerprints at most RING_BITS bits apart, and the sets decide the texts of a ring's
# component. Those bits reach down to a similarity of about 0.95, so what the ring leaves apart
# goes through a complete filter: shingles have one global order, and of a set of n the
# first n - ceil(similarity * n) + 1 are its `keys`. Two sets of at least that similarity share
# a key whatever the order is; putting shingles that are frequent in a sample last keeps shared
# passages and templates out of the keys. `sig` is a SimHash of SIG_BITS bits over the set; its
# Hamming distance estimates the similarity (standard error about 0.02 at 1024 bits) and spares
# exact comparisons; of under SMALL shingles it is the set itself, which is exact.
# The sets decide, and only those of likely pairs are ever made. A key that few texts hold is
# joined; the signatures of a key that many hold are compared block by block inside tasks.

SIG_BITS = 1024
RING_BITS = 3
SMALL = 256
#: Cells of the table of frequencies, and bytes of text (about) that it is counted on.
CELLS, CELL_CHUNKS, SAMPLE_BYTES = 1 << 22, 64, 1 << 27
_SIG_SALT = mix64(np.arange(1, SIG_BITS // 64 + 1, dtype=np.uint64))


def _wide(features: np.ndarray, salt: np.ndarray, at_once: int = 1 << 11) -> np.ndarray:
    """SimHash of 64 bits for each salt over hashed features, as uint64."""
    counts = np.zeros(64 * len(salt), np.int32)
    for k in range(0, len(features), at_once):
        mixed = mix64(features[k : k + at_once, None] ^ salt[None, :])
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(features)).view(np.uint64)


def _shingled(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and of the distinct shingles of each text; a text of fewer words is one shingle."""
    for lo, hi, data, offsets in slices(column):
        words = Words(data, offsets, SPACED)
        grams = words.grams(shingle)
        for r in range(hi - lo):
            a, b = words.first[r], words.first[r + 1]
            own = words.hash[a:b]
            yield own, np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else mix64(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64))


def _cells(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(CELLS - 1)).astype(np.int64)


def frequencies(df: DataFrame, *, text: str = "text", shingle: int = 5) -> np.ndarray:
    """How often the shingles of each cell occur in a sample of the texts, up to 255. It only orders shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint8)
        for batch in batches:
            for _, features in _shingled(batch.column(0), shingle):
                cells, times = np.unique(_cells(features), return_counts=True)
                table[cells] = np.minimum(table[cells] + times, 255)
        parts = table.reshape(CELL_CHUNKS, -1)
        used = [k for k in range(CELL_CHUNKS) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // CELL_CHUNKS, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())], ["part", "counts"])

    size = df.agg(F.sum(F.octet_length(quoted(text).cast("string")).cast("long"))).first()[0] or 0
    share = math.ceil(1024 * min(1.0, SAMPLE_BYTES / max(size, 1)))
    sample = df.select(quoted(text).cast("string").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1024)) < share)
    out = np.zeros((CELL_CHUNKS, CELLS // CELL_CHUNKS), np.uint8)
    for r in sample.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(r.counts, np.uint8)
    return out.reshape(-1)


def sketches(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows' key columns with `digest` (of the word sequence), `n` (distinct shingles), `keys`, `sig` and `fp`."""
    shared = df.sparkSession.sparkContext.broadcast(frequencies(df, text=text, shingle=shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            digests, sizes, prints, keys, sigs = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for own, features in _shingled(batch.column(2), shingle):
                n = len(features)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(n)
                sigs.append(features if n < SMALL else _wide(features, _SIG_SALT))
                prints.append(_wide(features, _SIG_SALT[:1]) if n < SMALL else sigs[-1][:1])
                keys.append(features[np.lexsort((features, often[_cells(features)]))[: n - math.ceil(similarity * n - 1e-9) + 1]])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x[1:])]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64))) for x in (keys, sigs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), *lists, pa.array(np.concatenate(prints).view(np.int64))], ["doc_id", "row", "digest", "n", "keys", "sig", "fp"])

    slim = df.select(quoted(key).cast("long").alias("doc_id"), row_hash(df).alias("row"), quoted(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {ROW}, digest binary, n int, keys array<long>, sig array<long>, fp long")


def shingle_sets(df: DataFrame, rows: DataFrame, wanted: DataFrame, *, text: str = "text", shingle: int = 5) -> DataFrame:
    """(digest, shingles) of the wanted digests: the hashed shingle set of one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, features in _shingled(batch.column(0), shingle):
                ends = pa.array([0, len(features)], pa.int32())
                digest = pa.array([xxhash.xxh3_128_digest(own.tobytes())], pa.binary())
                yield pa.RecordBatch.from_arrays([digest, pa.ListArray.from_arrays(ends, pa.array(features.view(np.int64)))], ["digest", "shingles"])

    one = rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("row").alias("row"))
    texts = df.select(row_hash(df).alias("row"), quoted(text).cast("string").alias("text")).join(one, "row", "left_semi")
    return texts.dropDuplicates(["row"]).select("text").mapInArrow(run, "digest binary, shingles array<long>")


ROW = "row struct<x:long,y:long>"


def row_hash(df: DataFrame) -> Column:
    """128 bits over all columns of a row, nulls told from values."""
    own = [F.when(quoted(c).isNull(), "null").otherwise(F.to_json(F.struct(quoted(c).alias("c")))) for c in df.columns]
    return F.struct(F.xxhash64(*own).alias("x"), F.xxhash64(F.lit("row"), *own).alias("y"))


def most_differing(similarity: float, bits: int = SIG_BITS, errors: float = 6.0) -> int:
    """Bits by which two signatures of that Jaccard similarity differ at most, within six standard errors."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def ring_pairs(prints: DataFrame, max_bits: int = RING_BITS) -> DataFrame:
    """(a, b), a < b: each digest (digest, fp) with the smallest one that links of fingerprints at most `max_bits` apart reach.

    A pair for each digest, however many links a group of near copies has.
    """
    found = connected_components(links(prints, max_bits))
    rooted = prints.join(found, prints.fp == found.node, "left").select("digest", F.coalesce("component", "fp").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("digest").alias("lead"))
    return rooted.join(leads, "root").filter("digest <> lead").select(F.col("lead").alias("a"), F.col("digest").alias("b"))


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, digest, n, there, lead) of the keys that several digests hold: how many do, and the smallest of them."""
    held = nodes.select("digest", "n", F.explode("keys").alias("key"))
    counted = held.groupBy("key").agg(F.count("*").alias("there")).filter("there > 1")
    shared = materialize(held.join(counted, "key"))
    return shared.join(shared.groupBy("key").agg(F.min("digest").alias("lead")), "key")


def candidates(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b), a < b: each digest with the lead of each of its keys, unless in one component already, to join groups of copies before the rest is met."""
    pairs = shared.filter("digest <> lead").select(F.col("lead").alias("a"), F.col("digest").alias("b")).distinct()
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"at_{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.filter(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b")


def apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of shared keys whose digests the components found so far keep apart, each with its `group`.

    Pairs of one component need no comparison, so a group of copies costs nothing from here on.
    """
    at = materialize(shared.join(found, shared.digest == found.node, "left").select("key", "digest", "n", "there", F.coalesce("component", "digest").alias("group")))
    mixed = at.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least <> most").select("key")
    return at.join(mixed, "key", "left_semi")


def _sized(similarity: float, a: str, b: str) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def few_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs of one key and different groups, sizes permitting."""
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.digest") < F.col("b.digest")) & (F.col("a.group") != F.col("b.group")) & _sized(similarity, "a.n", "b.n"))
    return met.select(F.col("a.digest").alias("a"), F.col("b.digest").alias("b")).distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 8192) -> np.ndarray:
    """How many elements each set of `left` has in common with each of `right`: products of membership matrices, so many elements at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    every = np.concatenate([*left, *right])
    names, of, times = np.unique(every, return_inverse=True, return_counts=True)
    kept = np.cumsum(times > 1) - 1  # elements of one set alone are in no overlap
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    row, column = row[times[of] > 1], kept[of[times[of] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, at_once):
        a, b = np.searchsorted(column, [lo, lo + at_once])
        table = np.zeros((len(left) + len(right), at_once), np.float32)
        table[row[a:b], column[a:b] - lo] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def _differing(left: np.ndarray, right: np.ndarray, at_once: int = 64) -> np.ndarray:
    """Hamming distance of each signature of `left` to each of `right` (rows of uint64)."""
    out = np.empty((len(left), len(right)), np.int32)
    for lo in range(0, len(left), at_once):
        out[lo : lo + at_once] = np.bitwise_count(left[lo : lo + at_once, None, :] ^ right[None, :, :]).sum(axis=2)
    return out


#: Digests of one key above which they are compared in blocks, and digests in a block, about.
MANY, BLOCK_ROWS = 64, 1024
#: Most earlier keys that a row carries into a block.
EARLIER = 64


def crowded_pairs(crowded: DataFrame, nodes: DataFrame, *, similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b), a < b: likely pairs among the texts that hold one key of many, whatever their number.

    The digests of a key are dealt to blocks by their hash and every two blocks meet in a task
    of their own, so no task has a whole key and no pair leaves it unless sizes and signatures
    allow it. Pairs that share one of their first EARLIER crowded keys below this one were met there.
    """
    first = crowded.groupBy("digest").agg(F.slice(F.array_sort(F.collect_list("key")), 1, EARLIER).alias("first"))
    told = crowded.join(first, "digest").withColumn("earlier", F.filter("first", lambda k: k < F.col("key")))
    told = told.select("key", "digest", "n", "group", "there", "earlier").join(nodes.select("digest", "sig"), "digest")
    blocks = F.ceil(F.col("there") / block_rows).cast("int")
    told = told.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("digest"), blocks).cast("int")})
    told = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    told = told.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("there", "blocks", "other")
    most = most_differing(similarity)

    def compare(table: pa.Table) -> pa.Table:
        lo = table["block"].to_numpy() == pc.min(table["block"]).as_py()
        two = not lo.all()
        a, b = np.flatnonzero(lo), np.flatnonzero(~lo) if two else np.flatnonzero(lo)
        n = table["n"].to_numpy()
        group = np.array(table["group"].to_pylist(), object)
        digest = np.array(table["digest"].to_pylist(), object)
        lists = lambda c: [x.values.to_numpy() for x in table[c]]
        earlier, sigs = lists("earlier"), lists("sig")
        pick = lambda x, side: [x[i] for i in side]
        na, nb = n[a][:, None], n[b][None, :]
        near = np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9
        near &= (group[a][:, None] != group[b][None, :]) & (_overlaps(pick(earlier, a), pick(earlier, b)) == 0)
        if not two:
            near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        (few_a, many_a), (few_b, many_b) = ((np.flatnonzero(n[x] < SMALL), np.flatnonzero(n[x] >= SMALL)) for x in (a, b))
        both = _overlaps(pick(sigs, a[few_a]), pick(sigs, b[few_b]))
        near[np.ix_(few_a, few_b)] &= both >= similarity * (na[few_a] + nb[:, few_b] - both) - 1e-6
        if len(many_a) and len(many_b):
            left, right = (np.stack(pick(sigs, x)).view(np.uint64) for x in (a[many_a], b[many_b]))
            near[np.ix_(many_a, many_b)] &= _differing(left, right) <= most
        pairs = [sorted((digest[a[i]], digest[b[j]])) for i, j in zip(*np.nonzero(near))]
        return pa.table({c: pa.array([p[k] for p in pairs], pa.binary()) for k, c in enumerate("ab")})

    return told.groupBy("key", "lo", "hi").applyInArrow(compare, "a binary, b binary")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and signatures allow to have at least that Jaccard similarity."""
    side = lambda c: nodes.select(F.col("digest").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = F.size(F.array_intersect("sig_a", "sig_b"))
    apart = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, d: t + d)
    allowed = F.when(large < SMALL, both >= similarity * (small + large - both) - 1e-9).when(small < SMALL, True).otherwise(apart <= most_differing(similarity))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.filter((small >= similarity * large - 1e-9) & allowed).select("a", "b")


def similar_links(pairs: DataFrame, df: DataFrame, rows: DataFrame, *, text: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity; sets are made of their texts only."""
    near = materialize(pairs.distinct())
    wanted = near.select(F.col("a").alias("digest")).union(near.select("b")).distinct()
    sets = materialize(shingle_sets(df, rows, wanted, text=text, shingle=shingle))
    full = lambda c: sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"set_{c}"))
    both, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    met = near.join(full("a"), "a").join(full("b"), "b").select("a", "b", both.alias("both"), total.alias("sum"))
    return materialize(met.filter(F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b"))


def near_duplicate_groups(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, many: int = MANY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(doc_id, row, root): rows of one root are near duplicates; `row` is a hash of the whole row.

    `many` and `block_rows` tell how pairs are compared, not which. The ring of the fingerprints
    joins close copies; only texts that it leaves apart are met by their keys.

    Word sequences that agree but for case and white space are one node before any search;
    texts without words (null, empty) form one group.
    """
    rows = materialize(sketches(df, key=key, text=text, shingle=shingle, similarity=similarity))
    similar = lambda pairs: similar_links(pairs, df, rows, text=text, shingle=shingle, similarity=similarity)
    ringed = similar(ring_pairs(rows.select("digest", "fp").distinct()))
    close = connected_components(ringed)
    nodes = rows.groupBy("digest").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    shared = materialize(shared_keys(nodes.select("digest", "n", "keys")))
    # only texts that share a key have partners
    nodes = materialize(nodes.drop("keys").join(shared.select("digest").distinct(), "digest", "left_semi"))
    led = connected_components(ringed.union(similar(likely(candidates(shared, close), nodes, similarity))))
    left = materialize(apart(shared, led))
    few = likely(few_pairs(left.filter(F.col("there") <= many), similarity), nodes, similarity)
    crowded = crowded_pairs(left.filter(F.col("there") > many), nodes, similarity=similarity, block_rows=block_rows)
    # the components so far are stars, which take fewer rounds to join than their links
    found = connected_components(led.select(F.col("component").alias("a"), F.col("node").alias("b")).union(similar(few.union(crowded))))
    return rows.join(found, rows.digest == found.node, "left").select("doc_id", "row", F.coalesce("component", "digest").alias("root"))


def drop_near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without all but one row of each group: the row of the smallest key (null last), then of the smallest row hash.

    Of repeated rows one stays; texts without words (null, empty) are a group like any other.
    The columns are df's own, whatever their names. No rows in, no rows out.
    """
    groups = near_duplicate_groups(df, key=key, text=text, shingle=shingle, similarity=similarity)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = materialize(groups.groupBy("root").agg(best.alias("best")).select(F.col("best.row").alias("id")))
    marked = df.select(packed(df.columns).alias("row"), row_hash(df).alias("id"))
    alone = marked.join(kept, "id", "left_semi")
    # repeated rows share a hash; only if there are any are they sought out
    times = groups.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row").alias("id"))
    again = materialize(times.join(kept, "id", "left_semi"))
    if not again.isEmpty():
        once = marked.join(again, "id", "left_semi").dropDuplicates(["id"])
        alone = alone.join(again, "id", "left_anti").unionByName(once)
    return alone.select(*unpacked(df.columns))
