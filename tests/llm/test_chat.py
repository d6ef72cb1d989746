"""Chat formatting read back exactly."""

import hashlib
import random

from pyspark.sql import functions as F

from tickloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = [*chat.CONTROL, "\\", "\\\\", "<", "[", "\n", " ", "é", "日本", "𝄞", "[\\INST]", "<\\/s>", "$1", "s>", "/INST]", "ok"]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    out = []
    for c, turns in convs.items():
        turns = [(r.decode(), x.decode()) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        merged = sum(i == 0 or turns[i - 1][0] != r for i, (r, _) in enumerate(turns))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha(told), len(loss), sha(loss), merged))
    return sorted(out, key=repr)


def got(spark, rows, schema=SCHEMA):
    out = chat.digest(chat.format_chats(spark.createDataFrame(rows, schema)))
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_merged) for r in out.collect()), key=repr)


def test_round_trip(spark):
    rng = random.Random(3)
    say = lambda: rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))])
    roles = ["user", "assistant", "assistant", "system", "tool", "", None, "User", "[SAYS]", "a\\[/ROLE]"]
    rows = [(rng.randrange(60), rng.randrange(7), rng.choice(roles), say()) for _ in range(600)]
    assert got(spark, rows) == brute(rows)


def test_escape_leaves_no_control_string(spark):
    rng = random.Random(4)
    texts = [("".join(rng.choice(PARTS) for _ in range(rng.randrange(12))),) for _ in range(500)]
    for r in spark.createDataFrame(texts, "t string").select("t", chat.escaped(F.col("t")).alias("e")).select("*", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(m in r.e for m in chat.CONTROL)


def test_marks_spans_and_merging(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "</s>")]
    (r,) = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.formatted == "[INST]a[NEXT]b[/INST]<s>c[NEXT]<\\/s></s>" and r.n_merged == 2
    assert [s.text for s in r.segments if s.loss] == ["c", "<\\/s>"]


def test_injection(spark):
    (r,) = chat.format_chats(chat.injection(spark)).collect()
    assert r.formatted == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"


def test_edges(spark):
    """Null keys, turns and texts, ties, repeats, one long conversation, a long text, clashing columns, no rows."""
    rows = [(None, None, None, None), (None, 0, "user", "x"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "assistant", "word </s> " * 100_000)]
    rows += [(3, i, ("user", "assistant")[i % 3 // 2], f"t{i}") for i in range(5000)]
    assert got(spark, rows) == brute(rows)
    wide = [(*r, 1, "z", [1]) for r in rows[:5]]
    assert got(spark, wide, SCHEMA + ", turns int, segments string, `merged` array<int>") == brute(rows[:5])
    assert got(spark, []) == []
