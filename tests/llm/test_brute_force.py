"""The operators against plain versions of the same rules, on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import annsearch, langid, pii, quality, simhash, tokencount
from tickloom.llm.common import crc32_mod
from tickloom.llm.queries import QUERIES, VOCABULARY


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def result(spark, sf_dir, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}


def test_language_held_out(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op1_language_id")
    held = [(d, lang) for d, lang in zip(docs.doc_id, docs.lang) if lang and got[d].held_out]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.97 * len(held)


def test_language_kernel():
    """Products of presence rows are the kernel of the sets of n-grams."""
    texts = ["Ab c", "abc, ab", "zz", "The cat sat on the mat"]

    def grams(t, n):
        t = re.sub("[^a-z]+", " ", t.lower())
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    got = langid.presence_matrix(texts, 1 << 18)
    got = got @ got.T
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            sets = [(grams(x, n), grams(y, n)) for n in langid.ORDERS]
            want = sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in sets if a and b) / len(langid.ORDERS)
            assert got[i, j] == pytest.approx(want, abs=1e-6)
    bits = np.array([np.frombuffer(langid.presence_bits(t), np.uint8) for t in texts])
    assert np.allclose(langid._from_bits(bits, langid.BUCKETS), langid.presence_matrix(texts))


def test_language_ignores_held_out_rows(spark, sf_dir):
    """The model does not change with the languages of rows that it must not learn from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine = crc32_mod(F.col("doc_id"), 3) != 1
    other = docs.withColumn("lang", F.when(mine, F.col("lang")).otherwise(F.lit("xx")))
    told = [langid.train(d, where=crc32_mod(F.col("k"), 3) != 1, landmarks=32) for d in (docs, other)]
    assert told[0].languages == told[1].languages and np.array_equal(told[0].weights, told[1].weights)


def test_factorisation_machine_margin():
    """The sum-of-squares identity against all pairs."""
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + quality.STATS
    machine = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros(quality.STATS), np.ones(quality.STATS), quality.BUCKETS, 0)
    words = [(np.array([3, 9, 700], np.int32), np.array([0.5, 0.2, 0.1], np.float32)), (np.zeros(0, np.int32), np.zeros(0, np.float32))]
    stats = rng.normal(size=(2, quality.STATS))
    x = quality._assemble(words, stats, machine)
    got, _ = quality._margin(machine, x)
    for r in range(2):
        ids, values = x.ids[x.starts[r] : x.starts[r + 1]], x.values[x.starts[r] : x.starts[r + 1]].astype(float)
        want = machine.bias + sum(machine.linear[i] * v for i, v in zip(ids, values))
        want += sum(machine.factors[ids[i]] @ machine.factors[ids[j]] * values[i] * values[j] for i in range(len(ids)) for j in range(i + 1, len(ids)))
        assert got[r] == pytest.approx(want, rel=1e-6)


def test_quality_held_out(spark, sf_dir):
    got = result(spark, "/root/testdata/sf0.01", "op8_quality")
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in marked if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.93 * len(held)


def test_decontamination(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op4_decontamination")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = word.findall(lower(r.text))
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(r.item_id))
    for d, text in zip(docs.doc_id, docs.text):
        w, hit, items = word.findall(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert tuple(got[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == (len(w), len(hit), len(items), sha, bool(hit))


def test_fingerprints_and_components(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op6_near_dedup")
    prints = []
    for text in docs.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)))
    a = np.array(prints, np.uint64)
    root = list(range(len(a)))
    while True:
        new = [min(root[j] for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)) for i in range(len(a))]
        if new == root:
            break
        root = new
    ids = docs.doc_id.tolist()
    least: dict = {}
    for i, d in enumerate(ids):
        least[root[i]] = min(d, least.get(root[i], d))
    for i, d in enumerate(ids):
        assert (got[d].fingerprint, got[d].component_id) == (f"{prints[i]:016x}", least[root[i]])


def test_near_duplicates_by_similarity(spark, sf_dir, docs):
    """The groups are the components of the links of similarity 0.8 or more, computed pair by pair."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = {r.doc_id: bytes(r.root) for r in simhash.near_duplicate_groups(rows).collect()}
    sets = {}
    for d, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    least = {d: d for d in ids}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            small, large = sorted((len(sets[x]), len(sets[y])))
            if small >= 0.8 * large and (both := len(sets[x] & sets[y])) >= 0.8 * (small + large - both):
                p, q = sorted((top(x), top(y)))
                least[q] = p
    want: dict = {}
    got: dict = {}
    for d in ids:
        want.setdefault(top(d), set()).add(d)
        got.setdefault(root[d], set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_mixing_targets(spark, sf_dir):
    rows = QUERIES["op3_mixing"](spark, sf_dir).toPandas()
    sums = rows.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    sums = sums.loc[sorted(sums.index, key=lambda s: (s is None or s != s, str(s).encode()))]
    weight = [(3, 1, 2)[i % 3] for i in range(len(sums))]
    full: set = set()
    while True:
        left = 1.5 * sums["size"].sum() - sum(2 * sums["size"].iloc[i] for i in full)
        over = {i for i in range(len(sums)) if i not in full and left * weight[i] / sum(w for j, w in enumerate(weight) if j not in full) > 2 * sums["size"].iloc[i]}
        if not over:
            break
        full |= over
    rest = sum(w for j, w in enumerate(weight) if j not in full)
    want = [2 * s if i in full else left * weight[i] / rest for i, s in enumerate(sums["size"])]
    assert np.allclose(sums.target, want)
    assert ((sums.taken - sums.target).abs() <= sums.largest / 2 + 1).all()
    assert sums.taken.sum() == pytest.approx(1.5 * sums["size"].sum(), rel=0.05)


def test_mixed_rows_are_what_the_mix_takes(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r.doc_id: r.epochs for r in QUERIES["op3_mixing"](spark, sf_dir).collect() if r.epochs}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert got == taken


def test_pii(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op7_pii")
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    for d, text in zip(docs.doc_id, docs.text):
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m[0]))
        told = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert got[d].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[d][f"n_{kind}"] for kind, *_ in kinds] == [sum(s[3] == kind for s in spans) for kind, *_ in kinds]


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    got: dict = {}
    for r in QUERIES["op5_nearest"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x * x[i]).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        order = [k for k in np.lexsort((ids, -score)) if k != i][:5]
        mine = got[ids[i]]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in mine} & {int(ids[k]) for k in order})
        exact = dict(zip(ids.tolist(), score))
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in mine)
    assert hits >= 0.9 * 5 * len(got)


def test_pii_added_kinds_and_redaction(spark):
    texts = [
        "Konto: DE89 3704 0044 0532 0130 00, bitte.",
        "Konto: DE89 3704 0044 0532 0130 01, bitte.",
        "Tel. 0221 4710-815 or 0221 4710-816",
        "The hotel has room 0221 4710-815",
        "Order 0221 4710-815, phone",
        "mail a@b.de and +49 221 4710815!",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[0].spans == "iban:7:34" and got[1].spans == ""
    assert got[2].spans == "local_phone:5:18,local_phone:22:35"
    assert got[3].spans == got[4].spans == ""
    assert got[5].max_score == 1.0
    told = [r.text for r in pii.redact(df).orderBy("doc_id").collect()]
    assert told[0] == "Konto: [iban], bitte." and told[1] == texts[1] and told[3] == texts[3]
    assert told[2] == "Tel. [local_phone] or [local_phone]" and told[5] == "mail [email] and [phone]!"


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_recall_over_blocks(spark, clustered):
    """Many blocks, cells that are not all probed, and a third of all rows equal."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 24)) * (3 if clustered else 0)
    x = (middles[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24))).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got: dict = {}
    for r in annsearch.nearest(df, queries=F.col("vec_id") % 50 == 0, sample=2000, depth=128, block_rows=500, block_queries=50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = x.astype(np.float64)
    hits = 0
    for i in range(0, 6000, 50):
        score = (x * x[i]).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        want = [int(k) for k in np.lexsort((np.arange(6000), -score)) if k != i][:5]
        mine = [got[i][k][0] for k in range(1, 6)]
        hits += len(set(want) & set(mine))
        if i % 3 == 0:
            assert mine == want
    assert hits >= 0.95 * 5 * 120


def test_tokens(spark, sf_dir, docs):
    import tiktoken

    got = result(spark, sf_dir, "op10_token_counts")
    plain = tiktoken.Encoding("plain", pat_str=tokencount.PATTERN, mergeable_ranks=tokencount.load_ranks(VOCABULARY), special_tokens={})
    assert all(got[d].n_tokens == len(plain.encode_ordinary(t or "")) for d, t in zip(docs.doc_id, docs.text))


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_of_flat_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for name, closed in (("a", True), ("b", False), ("c", True)):
        lengths = rng.integers(0, 9, 40).tolist() + ([] if closed else [5])
        ids = np.concatenate([np.append(rng.integers(0, 99, n), 99) for n in lengths]).astype("<u2")
        (ids if closed else ids[:-1]).tofile(tmp_path / name)
        want[name] = lengths
    (tmp_path / "d").touch()
    rows = tokencount.document_lengths(tokencount.scan(tokencount.read_token_files(spark, str(tmp_path), dtype="<u2", block=block), 99)).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.ordinal):
        got.setdefault(r.file.rpartition("/")[2], []).append(r.n_tokens)
    assert got == want


def test_pages_whole_article(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extraction"](spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(out.columns)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0
    assert out.filter(~F.col("shard").between(0, 23)).count() == 0
    hit = QUERIES["op4_decontamination"](spark, sf_dir).filter("contaminated")
    assert out.join(hit, "doc_id", "left_semi").count() == 0
    bad = QUERIES["op8_quality"](spark, sf_dir).filter("predicted = 0")
    assert out.join(bad, "doc_id", "left_semi").count() == 0


def jump(state, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((state >> 33) + 1)))
    return b


def test_shards(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op2_sharding")
    for d, text in zip(docs.doc_id, docs.text):
        state = int(hashlib.md5(str(d).encode()).hexdigest()[:16], 16)
        assert (got[d].shard, got[d].grown_shard) == (jump(state, 24), jump(state, 25))
        body = (text or "").encode()
        assert (got[d]["size"], got[d].text_crc32) == (len(body) + 8, zlib.crc32(body))
    for shard in {r.shard for r in got.values()}:
        slots = sorted(r.slot for r in got.values() if r.shard == shard)
        assert slots == list(range(len(slots)))
