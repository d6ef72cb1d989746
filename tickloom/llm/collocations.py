"""Phrase collocations by position bitmaps.

A shard is some megabytes of texts of one language. Every word of it has a compressed bitmap of
the positions where it stands: a packed array of bits where it is common, a sorted list of the
set bits where it is rare. Between pieces lies a position at which no bitmap is set, so a phrase
grows only within its piece: shift the bitmap of the phrase by one, AND it with the bitmaps of
the words, and the set bits that are left are the occurrences of the longer phrase. Blocks of
phrases are grown depth-first, so only one path of blocks is in memory. The counts are summed
over shards by Spark.

A phrase cannot be more frequent than its parts. After each length the phrases that are frequent
in the whole corpus set bits, by a hash, in a filter of fixed size, and the next pass follows no
phrase whose parts are not in it. The filter has no false negatives; what it lets through in
vain is counted and falls below the threshold. On a corpus so large that it fills up, it prunes
less and the counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, quoted
from tickloom.llm.textbytes import mix64

SHARD_BYTES = 4 << 20
#: A bit for each hash of a frequent phrase: 8 MB.
FILTER_BITS = 26
#: A word that stands at one position in so many, or more often, has its bits packed.
DENSE = 32
#: Set bits that are grown at once.
BLOCK = 1 << 17
COUNTS = "lang string, phrase string, a bigint"
_KIND = np.ones(256, np.uint8)
_KIND[[0x20, 0x09]] = 0  # between words
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2  # between pieces
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15 | 1


def _hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    words = pa.concat_arrays([words])
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    powers = np.full(int(length.max(initial=0)) + 1, _BASE, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], length)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])
        return mix64(total[offsets[1:]] - total[offsets[:-1]] + length.astype(np.uint64))


def _joined(lang: np.uint64, words: list[np.ndarray]) -> np.ndarray:
    """The hash of a phrase of a language from the hashes of its words."""
    out = np.full(len(words[0]), lang, np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            out = out * _TURN + w
    return mix64(out)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Shard:
    """The words of some texts: `words`, all of them in order as strings, and `gaps`, how many piece boundaries lie before each."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges = np.unique(offsets - offsets[0])[1:-1]
        kind = _KIND[data]
        inside = kind == 1
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        bounds = kind == 2
        cuts = np.concatenate([np.zeros(1, np.int32), np.cumsum(bounds, dtype=np.int32)])[begin] + np.searchsorted(edges, begin, "right").astype(np.int32)
        self.gaps = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(cuts) > 0)]) if len(cuts) else np.zeros(0, np.int64)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - begin)])
        self.words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]]))


class Bitmaps:
    """Position bitmaps of the words of a shard that are in the filter of frequent words."""

    def __init__(self, shard: Shard, lang: str, filters: list[np.ndarray]):
        coded = shard.words.dictionary_encode()
        ids, self.filters = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), filters
        self.lang = _hashes(pa.array([lang], pa.large_string()))[0]
        hashes = _hashes(coded.dictionary)
        frequent = np.flatnonzero(_has(filters[0], _joined(self.lang, [hashes])))
        self.names, self.hash = coded.dictionary.take(pa.array(frequent)), hashes[frequent]
        new = np.full(len(hashes), -1, np.int64)
        new[frequent] = np.arange(len(frequent))
        # the word at each position, -1 at those between pieces and at the end
        self.word_at = np.full(len(ids) + (int(shard.gaps[-1]) if len(ids) else 0) + 1, -1, np.int64)
        self.word_at[np.arange(len(ids)) + shard.gaps] = new[ids]
        there = np.flatnonzero(self.word_at >= 0)
        self.set_bits = there[np.argsort(self.word_at[there], kind="stable")]
        count = np.bincount(self.word_at[there], minlength=len(frequent))
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        self.is_dense = count * DENSE >= len(self.word_at)
        self.dense = np.flatnonzero(self.is_dense)
        self.packed = {int(w): self._pack(self.positions(w)) for w in self.dense}

    def positions(self, word: int) -> np.ndarray:
        return self.set_bits[self.bounds[word] : self.bounds[word + 1]]

    def _pack(self, positions: np.ndarray) -> np.ndarray:
        bits = np.zeros(-(-len(self.word_at) // 64) * 64, np.uint8)
        bits[positions] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def _unpack(self, packed: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(packed.view(np.uint8), bitorder="little"))

    def grown(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases as a row of words each, occurrences) of that length, every phrase once."""
        for w in self.dense:
            yield from self._from_dense(int(w), length)
        rare = np.flatnonzero(~self.is_dense)
        size = np.cumsum(np.diff(self.bounds)[rare])
        for at in np.split(rare, np.searchsorted(size, np.arange(BLOCK, size[-1], BLOCK))) if len(rare) else []:
            if not len(at):
                continue
            count = self.bounds[at + 1] - self.bounds[at]
            bits = self.set_bits[np.repeat(self.bounds[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            yield from self._deeper(at[:, None], count, bits, length)

    def _from_dense(self, word: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Grow a packed bitmap: shifted as a whole, ANDed with the packed ones word by word, with the lists of set bits at once."""
        bits = self.packed[word]
        moved = bits << np.uint64(1)
        moved[1:] |= bits[:-1] >> np.uint64(63)
        both = [(v, moved & self.packed[int(v)]) for v in self.dense]
        counts = np.array([int(np.bitwise_count(x).sum()) for _, x in both])
        kept = np.flatnonzero((counts > 0) & self._wanted(np.array([[word, v] for v, _ in both]), length))
        if len(kept):
            found, counts = np.array([[word, both[i][0]] for i in kept]), counts[kept]
            if length == 2:
                yield found, counts
            else:
                yield from self._deeper(found, counts, np.concatenate([self._unpack(both[i][1]) for i in kept]), length)
        shifted = self.positions(word) + 1
        after = self.word_at[shifted]
        shifted = shifted[(after >= 0) & ~self.is_dense[after]]
        yield from self._met(np.array([[word]]), np.zeros(len(shifted), np.int64), shifted, length)

    def _deeper(self, phrases: np.ndarray, counts: np.ndarray, bits: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Grow phrases whose set bits, at their last words, lie one after the other, in blocks."""
        ends = np.cumsum(counts)
        stops = np.unique(np.append(np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK), "right"), len(phrases)))
        lo = 0
        for hi in stops[stops > 0]:
            first, last = ends[lo] - counts[lo], ends[hi - 1]
            shifted = bits[first:last] + 1
            owner = np.repeat(np.arange(hi - lo), counts[lo:hi])
            on = self.word_at[shifted] >= 0
            yield from self._met(phrases[lo:hi], owner[on], shifted[on], length)
            lo = hi

    def _met(self, phrases: np.ndarray, owner: np.ndarray, shifted: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each shifted bit meets the one word whose bitmap is set there; the bits of a phrase and a word are what their AND leaves."""
        if not len(shifted):
            return
        key = owner * len(self.names) + self.word_at[shifted]
        order = np.argsort(key, kind="stable")
        key, shifted = key[order], shifted[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(first, len(key)))
        longer = np.column_stack([phrases[key[first] // len(self.names)], key[first] % len(self.names)])
        kept = self._wanted(longer, length)
        if not kept.any():
            return
        if longer.shape[1] == length:
            yield longer[kept], counts[kept]
        else:
            yield from self._deeper(longer[kept], counts[kept], shifted[np.repeat(kept, counts)], length)

    def _wanted(self, phrases: np.ndarray, length: int) -> np.ndarray:
        """Whether the phrases, or of those of full length what follows the first word, are in the filter of their length."""
        words = phrases[:, 1:] if phrases.shape[1] == length else phrases
        return _has(self.filters[words.shape[1] - 1], _joined(self.lang, [self.hash[words[:, i]] for i in range(words.shape[1])]))


def _rows(lang: str, phrases: pa.Array | list, counts: np.ndarray | list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "a"])


def _count_words(shard: Shard, lang: str) -> Iterator[pa.RecordBatch]:
    """Each word of the shard with its number, and a null for the number of all."""
    if len(shard.words):
        coded = shard.words.dictionary_encode()
        yield _rows(lang, coded.dictionary.cast(pa.string()), np.bincount(coded.indices.to_numpy(zero_copy_only=False)))
        yield _rows(lang, [None], [len(shard.words)])


def _count_phrases(shard: Shard, lang: str, filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    length = len(filters) + 1
    maps = Bitmaps(shard, lang, filters)
    for phrases, counts in maps.grown(length):
        text = pc.binary_join_element_wise(*[maps.names.take(pa.array(phrases[:, i])) for i in range(length)], pa.scalar(" ", pa.large_string()))
        yield _rows(lang, text.cast(pa.string()), counts)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """Texts of one language, of about SHARD_BYTES for all languages together (a longer text is not cut)."""
    held: dict[str, list[pa.Array]] = {}
    size = 0
    for batch in batches:
        texts, at = batch["text"].cast(pa.large_string()), 0
        lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while at < len(batch):
            before = lengths[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(lengths, before + SHARD_BYTES - size, "right")))
            part = batch.slice(at, stop - at)
            for lang in part["lang"].unique().to_pylist():
                held.setdefault(lang, []).append(texts.slice(at, stop - at).filter(pc.equal(part["lang"], lang)))
            size += int(lengths[stop - 1] - before)
            at = stop
            if size >= SHARD_BYTES or at < len(batch):
                yield from ((lang, Shard(pa.concat_arrays(held.pop(lang)))) for lang in sorted(held))
                size = 0
    yield from ((lang, Shard(pa.concat_arrays(held.pop(lang)))) for lang in sorted(held))


def _frequent(texts: DataFrame, filters: list[np.ndarray], least: int) -> DataFrame:
    """(lang, phrase, a) of the phrases one word longer than the last filter's with a >= least, and of all words of a language (phrase null); written to the checkpoint folder."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            yield from _count_phrases(shard, lang, shared.value) if shared.value else _count_words(shard, lang)

    counted = texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    out = materialize(counted.filter((F.col("a") >= least) | F.col("phrase").isNull()))
    shared.destroy()
    return out


def _filter(frequent: DataFrame) -> np.ndarray:
    """The filter of these phrases: 2^FILTER_BITS bits, of which the driver gets the words that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if len(b)):
            parts = pc.split_pattern(batch["phrase"].cast(pa.large_string()), " ")
            words = _hashes(pa.concat_arrays([parts.flatten()]))
            lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            n, langs = int(lengths[0]), _hashes(batch["lang"].cast(pa.large_string()))
            out = langs
            with np.errstate(over="ignore"):
                for i in range(n):
                    out = out * _TURN + words[i::n]
            at = mix64(out) & np.uint64((1 << FILTER_BITS) - 1)
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    set_bits = frequent.filter("phrase IS NOT NULL").select("lang", "phrase").mapInArrow(run, "word int, bits bigint")
    words = set_bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def phrase_counts(docs: DataFrame, *, longest: int = 4, least: int = 30) -> DataFrame:
    """(lang, phrase, size, a): how often each phrase of 1 to `longest` words occurs within pieces, if at least `least` times, overlaps included; and a row with null phrase and size 0 for the number of all words.

    docs: text, lang (null: und; null texts are empty). A-Z are lower-cased; pieces end at
    .,;:!? and line breaks, words at spaces and tabs. One pass over the texts per length.
    """
    texts = docs.select(F.coalesce(quoted("text"), F.lit("")).alias("text"), F.coalesce(quoted("lang").cast("string"), F.lit("und")).alias("lang"))
    filters: list[np.ndarray] = []
    found: list[DataFrame] = []
    for size in range(1, longest + 1):
        found.append(_frequent(texts, filters, least))
        if size < longest:
            filters.append(_filter(found[-1]))
    out = found[0].withColumn("size", F.when(F.col("phrase").isNull(), 0).otherwise(1))
    for size, more in enumerate(found[1:], 2):
        out = out.unionByName(more.withColumn("size", F.lit(size)))
    return out.select("lang", "phrase", "size", "a")


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, *, longest: int = 4, least: int = 30, covered: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words by how firmly they hang together: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count; cut after its first k words, l and r are those of the two parts and
    the score is floor(scale * a / (l + r)) of the cut with the lowest (then the smallest k); n
    counts all words of the language. A phrase within a longer one that has at least `covered`
    percent of its count is left out. Order: score and a descending, phrase ascending by bytes.
    No texts, or no phrase so frequent: no rows. Rows that repeat count again; columns other
    than text and lang are not looked at.
    """
    counts = phrase_counts(docs, longest=longest, least=least)
    long = counts.filter("size >= 2").withColumn("words", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    cover = long.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = long.join(cover, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide("longer") < covered * wide("a")))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.filter("size > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"CAST({scale} AS DECIMAL(18,0)) * a DIV (CAST(l AS DECIMAL(20,0)) + r)"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("a").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
