"""Collocations against a brute-force count, and at small shards, filters and blocks."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tickloom.llm import collocations as col

SCHEMA = "text string, lang string"


def brute(docs, longest, least, covered, top, scale=2_000_000):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        hidden = {q for p, a in cands.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= covered * f[q := p[i : i + m]]}
        rows = []
        for p, a in cands.items():
            if p in hidden:
                continue
            score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(spark, docs, schema=SCHEMA, **options):
    rows = col.collocations(spark.createDataFrame(docs, schema).repartition(3), **options).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "naïve", "x" * 40, "日本", "über", "b\x00c", " ", "end", "and"] + [f"w{i}" for i in range(30)]
    text = lambda: "".join(rng.choice(vocabulary[: rng.choice((4, 12, 42))]) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", ";x:", "\n", "!?", "\r\x0b"]) for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "en", "en", "de", None, "und", "", "l' x"])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "shard", "block", "dense", "bits"), [(1, 12 << 20, 1 << 17, 32, 26), (2, 200, 5, 4, 26), (3, 5000, 50, 1000, 8), (4, 12 << 20, 3, 2, 12)])
def test_brute_force(spark, monkeypatch, seed, shard, block, dense, bits):
    """Small shards, blocks, filters that let nearly all through and all words dense give the same rows. The options travel with the closures: tasks get a fresh module, so they are set by value there."""
    docs = made(150, seed)
    for name, value in (("SHARD_BYTES", shard), ("BLOCK", block), ("DENSE", dense), ("FILTER_BITS", bits)):
        monkeypatch.setattr(col, name, value)
    # without Spark: the shards of these options, level by level
    rows = pa.record_batch([pa.array([t for t, _ in docs]), pa.array([lang or ("" if lang == "" else "und") for _, lang in docs])], ["text", "lang"])
    filters = []
    levels = {}
    for size in range(1, 5):
        total = Counter()
        for lang, part in col._shards(iter([rows.slice(0, 70), rows.slice(70)])):
            for b in col._count_phrases(part, lang, filters) if filters else col._count_words(part, lang):
                total.update({(r["lang"], r["phrase"]): r["a"] for r in b.to_pylist() if r["phrase"] is not None})
        levels[size] = {k: a for k, a in total.items() if a >= 3}
        bits_ = col.np.zeros(1 << bits - 6 if bits > 6 else 1, col.np.uint64)
        for lang, phrase in levels[size]:
            words = col._hashes(pa.array(phrase.split(" "), pa.large_string()))
            at = int(col._joined(col._hashes(pa.array([lang], pa.large_string()))[0], [words[i : i + 1] for i in range(size)])[0]) & ((1 << bits) - 1)
            bits_[at >> 6] |= col.np.uint64(1 << (at & 63))
        filters.append(bits_)
    want = brute(docs, 4, 3, 101, 10**9)
    got = sorted((lang, p, a) for size in (2, 3, 4) for (lang, p), a in levels[size].items())
    assert got == sorted((r[0], r[2], r[3]) for r in want)


@pytest.mark.parametrize("seed", [5, 6])
def test_whole(spark, seed):
    docs = made(200, seed)
    for options in (dict(longest=4, least=3, covered=80, top=25), dict(longest=3, least=2, covered=50, top=2000)):
        assert found(spark, docs, **options) == brute(docs, **options)


def test_edges(spark):
    """Null text and lang, no words, repeats, clashing columns, one long text, overlaps and pieces, no rows."""
    options = dict(longest=4, least=3, covered=80, top=10)
    docs = [(None, "en"), ("", None), (" \t.,", None), ("a a a a a", "en"), ("a a. a a", None), ("A b\tc " * 4000, "en")] + [("same pair here", None)] * 3
    assert found(spark, docs, **options) == brute(docs, **options)
    wide = [(t, g, 1, "x", 2) for t, g in docs]
    assert found(spark, wide, "text string, lang string, a long, phrase string, size int", **options) == brute(docs, **options)
    assert found(spark, [], **options) == []
    assert found(spark, [(None, None)], **options) == []


def test_scores_pass_64_bits(spark):
    docs = [("p q", "en")] * 40
    (row,) = found(spark, docs, longest=2, least=30, covered=80, top=5, scale=10**18 - 1)
    assert row[-1] == (10**18 - 1) * 40 // 80
