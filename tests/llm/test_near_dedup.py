"""Near duplicates of the pipeline at the exact threshold, on small made-up texts."""

import numpy as np

from tickloom.llm import simhash


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(x, y):
    both = len(shingles(x) & shingles(y))
    return both / (len(shingles(x)) + len(shingles(y)) - both)


def roots(spark, texts, **options):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: bytes(r.root) for r in simhash.near_duplicate_groups(df, **options).collect()}


def scattered(rng, w, edits):
    """A copy with so many single words changed, each in shingles of its own."""
    out = list(w)
    for at in np.linspace(5, len(w) - 6, edits).astype(int):
        out[at] = words(rng, 1)[0]
    return out


def test_exact_threshold(spark):
    """With m edits of 404 words 5m of 400 shingles differ: 8 give 360/440 = 0.818, 9 give 0.798."""
    rng = np.random.default_rng(5)
    texts, linked = [], []
    for k in range(60):
        base = words(rng, 404)
        texts += [base, scattered(rng, base, 8 + k % 2)]
        linked.append(similarity(*texts[-2:]) >= 0.8)
    got = roots(spark, texts)
    assert linked == [k % 2 == 0 for k in range(60)]
    assert [got[2 * k] == got[2 * k + 1] for k in range(60)] == linked


def test_block_edits(spark):
    """Copies with a replaced tail, an appended or a prepended passage, down to 0.8, all meet."""
    rng = np.random.default_rng(6)
    texts, linked = [], []
    for k in range(60):
        base, more = words(rng, 400), words(rng, 200)
        changed = (base[: 400 - 20 - k // 3] + more[: 20 + k // 3], base + more[: 60 + k // 2], more[: 60 + k // 2] + base)[k % 3]
        texts += [base, changed]
        linked.append(similarity(base, changed) >= 0.8)
    got = roots(spark, texts)
    assert sum(linked) >= 50
    assert [got[2 * k] == got[2 * k + 1] for k in range(60)] == linked


def test_pairs_behind_a_leader(spark):
    """Two similar texts share keys only with many others below 0.8; they meet all the same."""
    rng = np.random.default_rng(7)
    texts, pairs = [], []
    for _ in range(8):
        shared = words(rng, 364)
        pairs.append((len(texts), len(texts) + 1))
        texts += [shared + words(rng, 40), shared + words(rng, 40)]
        texts += [cut + words(rng, 20) for cut in [shared[:304], shared[60:]] * 8]
        assert similarity(*texts[pairs[-1][0] : pairs[-1][1] + 1]) >= 0.8
        assert max(similarity(texts[pairs[-1][0]], t) for t in texts[pairs[-1][1] + 1 :]) < 0.8
    got = roots(spark, texts)
    assert [got[x] == got[y] for x, y in pairs] == [True] * 8
    assert all(got[x] != got[x + 2] for x, _ in pairs)


def groups(root):
    out = {}
    for d, r in root.items():
        out.setdefault(r, set()).add(d)
    return sorted(map(sorted, out.values()))


def test_blocks_find_what_joins_find(spark):
    """A crowd of copies near the threshold, compared pair by pair, in blocks, and by brute force."""
    rng = np.random.default_rng(8)
    base = words(rng, 120)
    texts = [scattered(rng, base, int(k)) for k in rng.integers(1, 5, 60)] + [words(rng, 90) + base for _ in range(5)]
    texts += [base * 12, [*base * 12, *words(rng, 3)], [*words(rng, 1100)], []]
    texts += [[*texts[-2], "end"], [*texts[-2], "other", "end"]]
    link = [[j for j in range(len(texts)) if shingles(texts[i]) and shingles(texts[j]) and similarity(texts[i], texts[j]) >= 0.8] for i in range(len(texts))]
    want, left = [], set(range(len(texts)))
    while left:
        seen, new = set(), {min(left)}
        while new:
            seen |= new
            new = {j for i in new for j in link[i]} - seen
        want.append(sorted(seen))
        left -= seen
    for options in ({}, dict(many=1, block_rows=7), dict(many=4, block_rows=1000)):
        assert groups(roots(spark, texts, **options)) == sorted(want)


def test_crowded_fingerprints(spark):
    """Fingerprints that share a segment are all linked, whether their key is split or not."""
    rng = np.random.default_rng(9)
    fps = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 50)}
    for x in list(fps):
        for _ in range(20):
            bits = rng.choice(64, int(rng.integers(1, 5)), replace=False)
            y = (x & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps |= {0x7777000000000000 | int(x) << 20 for x in rng.integers(0, 1 << 28, 400)}
    a = np.array(sorted(fps), np.int64)
    u = a.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    want = {(int(a[i]), int(a[j])) for i, j in zip(*np.nonzero(near)) if i < j}
    df = spark.createDataFrame([(int(x),) for x in a], "fp long")
    for crowd in (1, 10, 1000):
        assert {tuple(r) for r in simhash.links(df, crowd=crowd).collect()} == want


def test_ring_joins_close_copies(spark, monkeypatch):
    """Without any shared key, the fingerprints' ring alone joins copies within its bits, of few and of many shingles; the sets still decide."""
    rng = np.random.default_rng(10)
    texts = []
    for k in range(20):
        base = words(rng, 150 if k % 2 else 1500)
        texts += [base, [*base, *words(rng, 1)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.sketches(df).collect()}
    close = [(fp[2 * k] ^ fp[2 * k + 1]).bit_count() <= 3 for k in range(20)]
    assert sum(close) >= 15
    keys = simhash.shared_keys
    monkeypatch.setattr(simhash, "shared_keys", lambda nodes: keys(nodes).filter("false"))
    got = roots(spark, texts)
    assert [got[2 * k] == got[2 * k + 1] for k in range(20)] == close
    assert len(set(got.values())) == 40 - sum(close)
    # texts whose fingerprints agree but whose sets do not are no copies
    monkeypatch.setattr(simhash, "_wide", lambda features, salt: np.zeros(len(salt), np.uint64))
    assert len(set(roots(spark, [words(rng, 50) for _ in range(4)]).values())) == 4


def test_what_the_ring_has_joined_meets_no_more(spark):
    """A pair within one component is no candidate of the keys."""
    shared = spark.createDataFrame([(7, b"a", b"a"), (7, b"b", b"a"), (7, b"c", b"a")], "key long, digest binary, lead binary")
    found = spark.createDataFrame([(b"a", b"a"), (b"b", b"a")], "node binary, component binary")
    assert [(bytes(r.a), bytes(r.b)) for r in simhash.candidates(shared, found).collect()] == [(b"a", b"c")]
