"""Benchmark decontamination by winnowing.

Of every `window - k + 1` consecutive k-grams of words the smallest hash is a fingerprint, so
any run of `window` words that a document shares with a benchmark item has a fingerprint that
both sides keep. Fingerprints are looked up first; around each hit the windows that hold it
are compared word by word, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, packed, quoted, schema_with, text_within, unpacked
from tickloom.llm.textbytes import ALNUM, Words, slices

WINDOW, K = 10, 5

#: Rows and bytes of the benchmark index that one pass over the documents takes; a larger
#: benchmark is gone through in so many passes as it takes.
INDEX_ROWS, INDEX_BYTES = 1_000_000, 1 << 27

INDEX_SCHEMA = "n int, window_hash long, print_hash long, words binary, item string"


def _usable(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each word on lie in one text."""
    count = max(0, len(words) - n + 1)
    ok = np.zeros(count, bool)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            ok[a : b - n + 1] = True
    return ok


def _extreme(x: np.ndarray, n: int, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over each run of n values."""
    out = x[: len(x) - n + 1].copy()
    for i in range(1, n):
        ufunc(out, x[i : len(x) - n + 1 + i], out=out)
    return out


def winnowed(grams: np.ndarray, span: int) -> np.ndarray:
    """Which grams are the smallest of some run of `span` (all of them, on ties)."""
    if len(grams) < span:
        return np.zeros(len(grams), bool)
    least = _extreme(grams, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    return _extreme(np.concatenate([pad, least, pad]), span, np.maximum) == grams


def benchmark_index(items: DataFrame, *, item: str, text: str, window: int, k: int) -> DataFrame:
    """(n, window_hash, print_hash, words, item): every window of every item, the fingerprint in it, and its words, spaced.

    An item with fewer words than a window, but not none, is one window. Null ids count as "".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                for r in range(hi - lo):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    if a == b:
                        continue
                    n = min(window, b - a)
                    own = words.grams(n)[a : b - n + 1]
                    least = _extreme(words.grams(k)[a : b - k + 1], window - k + 1, np.minimum) if n == window else own
                    told = [words.spelled(x, n) for x in range(a, b - n + 1)]
                    columns = [pa.array(np.full(len(own), n, np.int32)), pa.array(own.view(np.int64)), pa.array(least.view(np.int64)), pa.array(told, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.repeat(batch.column(0)[lo + r], len(own))], ["n", "window_hash", "print_hash", "words", "item"])

    slim = items.select(F.coalesce(quoted(item).cast("string"), F.lit("")).alias("item"), quoted(text).cast("string").alias("text"))
    return slim.mapInArrow(run, INDEX_SCHEMA).distinct()


def _sieve(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[values >> np.uint64(44)] = True
    return table


def _tables(rows: pa.Table) -> dict[int, tuple]:
    """By the number of words of a window: its hashes, for each of them {words: items}, the fingerprints, and sieves of both."""
    found: dict[int, dict[int, dict[bytes, list[str]]]] = {}
    names: dict[str, str] = {}  # a name is held once, however many windows it has
    prints: dict[int, set[int]] = {}
    for n, h, p, words, item in zip(*(rows[c].to_pylist() for c in ("n", "window_hash", "print_hash", "words", "item"))):
        found.setdefault(n, {}).setdefault(h & (2**64 - 1), {}).setdefault(words, []).append(names.setdefault(item, item))
        prints.setdefault(n, set()).add(p & (2**64 - 1))
    by_n = {}
    for n, own in sorted(found.items()):
        hashes = np.array(sorted(own), np.uint64)
        kept = np.array(sorted(prints[n]), np.uint64)
        by_n[n] = (hashes, [own[int(h)] for h in hashes], kept, _sieve(kept), _sieve(hashes))
    return by_n


def _among(values: np.ndarray, positions: np.ndarray, table: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions, those whose value is in the sorted table, and where it is there."""
    positions = positions[sieve[values[positions] >> np.uint64(44)]]
    at = np.searchsorted(table, values[positions])
    at[at == len(table)] = 0
    ok = table[at] == values[positions]
    return positions[ok], at[ok]


def _occurrences(words: Words, index: dict[int, tuple], window: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """(n, starts of windows whose hash is in the table, their places there, the table)."""
    for n, table in index.items():
        hashes, _, prints, print_sieve, hash_sieve = table
        if len(words) < n:
            continue
        usable = _usable(words, n)
        if n == window:
            grams = words.grams(k)
            span = window - k + 1
            hits, _ = _among(grams, np.flatnonzero(winnowed(grams, span)), prints, print_sieve)
            starts = np.unique(hits[:, None] - np.arange(span)[None, :]) if len(hits) else hits
            starts = starts[(starts >= 0) & (starts < len(usable))]
            starts = starts[usable[starts]]
        else:
            starts = np.flatnonzero(usable)
        if len(starts):
            starts, places = _among(words.grams(n), starts, hashes, hash_sieve)
            if len(starts):
                yield n, starts, places, table


SPANS_TYPE = "array<struct<start:int,stop:int>>"
HIT_COLUMNS = f"spans {SPANS_TYPE}, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    k: int = K,
    index_rows: int = INDEX_ROWS,
    index_bytes: int = INDEX_BYTES,
    keep_row: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (of hit words, from 0, stop exclusive), items (ids with a window in the text).

    Words are runs of ASCII letters, digits and other than ASCII, in lower case; a null text
    has none. An empty benchmark hits nothing; repeated documents and items do no harm. With
    keep_row the input's columns come first, packed into a struct `row`, else the key as doc_id.

    The rows and bytes of the benchmark's index are counted; a part of about `index_rows` rows
    and `index_bytes` is broadcast at once, and each further part is a further pass over the
    documents, which carry their hits along. A window that many items share is spread over the
    parts like any other, as parts are told by window and item.
    """
    if not k <= window:
        raise ValueError("k must not be above window")
    spark = docs.sparkSession
    index = materialize(benchmark_index(benchmark, item=item, text=item_text, window=window, k=k))
    rows_there, bytes_there = index.agg(F.count("*"), F.coalesce(F.sum(64 + F.octet_length("words") + F.octet_length("item")), F.lit(0))).first()
    passes = max(1, -(-rows_there // index_rows), -(-bytes_there // index_bytes))
    given, first = (packed(docs.columns), "row") if keep_row else (quoted(key), "doc_id")
    texts, extra = text_within(docs, docs.columns if keep_row else [], text)
    rows = docs.select(given.alias(first), F.lit(None).cast(SPANS_TYPE).alias("spans"), F.lit(None).cast("array<string>").alias("items"), *extra)
    for p in range(passes):
        block = index if passes == 1 else index.filter(F.pmod(F.xxhash64("window_hash", "words", "item"), F.lit(passes)) == p)
        shared = spark.sparkContext.broadcast(_tables(block.toArrow()))
        last = p == passes - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, items = [], [], []
                for lo, hi, data, offsets in slices(texts(batch)):
                    words = Words(data, offsets, ALNUM)
                    found: dict[int, tuple[list, set]] = {}
                    for n, starts, places, (_, told, *_) in _occurrences(words, shared.value, window, k):
                        owner = np.searchsorted(words.first, starts, "right") - 1
                        for s, place, r in zip(starts.tolist(), places.tolist(), owner.tolist()):
                            names = told[place].get(words.spelled(s, n))
                            if names is not None:
                                own, which = found.setdefault(r, ([], set()))
                                own.append((s - int(words.first[r]), s - int(words.first[r]) + n))
                                which.update(names)
                    counts += np.diff(words.first).tolist()
                    for r in range(hi - lo):
                        own, which = found.get(r, ((), ()))
                        before, named = batch.column(1)[lo + r].as_py() or [], batch.column(2)[lo + r].as_py() or []
                        spans.append(_merged([*own, *((x["start"], x["stop"]) for x in before)]))
                        items.append(sorted({*which, *named}))
                told = [pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *told], [first, "n_words", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), *told, *batch.columns[3:]], batch.schema.names)

        rows = rows.mapInArrow(run, schema_with(rows, first, f"n_words long, {HIT_COLUMNS}" if last else ", ".join([HIT_COLUMNS, *["text_ string"] * len(extra)])))
        if not last:
            rows = materialize(rows)
    return rows


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = contamination(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
        "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a window of the benchmark.

    Null and empty texts hold none and stay, repeated rows stay or go together, a text of any
    length is searched whole. The columns are docs' own, whatever their names.
    """
    found = contamination(docs, benchmark, keep_row=True, **options)
    return found.filter(F.size("spans") == 0).select(*unpacked(docs.columns))
