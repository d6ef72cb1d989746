"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the blended spectrum of orders 1 to n: for each order the number of
n-grams (of code points, lower case) present in both, over the geometric mean of the numbers
present in each, averaged over the orders. Landmarks span the feature space; one ridge
regression per language against the rest is solved in it. As the kernel is a product of
presence vectors, landmarks and weights fold into one matrix: a batch of texts is scored by
multiplying its presence matrix with that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import packed, quoted, schema_with, unpacked
from tickloom.llm.textbytes import mix64

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # orders * buckets x languages
    buckets: int


def presence(text: str, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each order, the sorted distinct buckets of the text's n-grams; each run of other than letters counts as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    plain = np.where((codes < 128) & ~((codes >= 97) & (codes <= 122)), np.uint64(32), codes)
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    plain = plain[keep]
    seen, gram = [], np.zeros(len(plain), np.uint64)
    for n in range(1, len(ORDERS) + 1):
        gram = gram[: max(0, len(plain) - n + 1)] * np.uint64(0x110000) + plain[n - 1 :]
        hit = np.zeros(buckets, bool)
        hit[mix64(gram) & np.uint64(buckets - 1)] = True
        seen.append(np.flatnonzero(hit))
    return seen


def presence_matrix(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """texts x (orders * buckets): 1 / sqrt(grams present of that order) where present, so that rows multiply to kernel values."""
    out = np.zeros((len(texts), len(ORDERS) * buckets), np.float32)
    for row, text in zip(out, texts):
        for k, hits in enumerate(presence(text, buckets)):
            if len(hits):
                row[k * buckets + hits] = 1 / np.sqrt(len(hits) * len(ORDERS))
    return out


def presence_bits(text: str, buckets: int = BUCKETS) -> bytes:
    """The text's presence vectors of all orders, a bit a bucket: the same few KB however long the text is."""
    hit = np.zeros(len(ORDERS) * buckets, bool)
    for k, hits in enumerate(presence(text, buckets)):
        hit[k * buckets + hits] = True
    return np.packbits(hit).tobytes()


def _from_bits(bits: np.ndarray, buckets: int) -> np.ndarray:
    """The rows of presence_matrix() for rows of presence_bits()."""
    hit = np.unpackbits(bits, axis=1).reshape(len(bits), len(ORDERS), buckets).astype(np.float32)
    number = hit.sum(axis=2, keepdims=True)
    return (hit / np.sqrt(np.maximum(number, 1) * len(ORDERS))).reshape(len(bits), -1)


def fit(bits: np.ndarray, languages: list[str], *, landmarks: int = 256, ridge: float = 1e-2, buckets: int = BUCKETS, at_once: int = 128) -> LanguageModel:
    """One-versus-rest kernel ridge regression in the span of the landmarks (the first of each language in turn).

    `bits` has the presence_bits() of a training text in each row.
    """
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((len(ORDERS) * buckets, 0), np.float32), buckets)
    seen: Counter[str] = Counter()
    turns = []  # how many of the row's language come before it
    for lang in languages:
        turns.append(seen[lang])
        seen[lang] += 1
    chosen = np.argsort(turns, kind="stable")[:landmarks]
    basis = _from_bits(bits[chosen], buckets)
    kernel = (basis @ basis.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-8 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])  # landmark kernel values -> Nystroem features
    features = np.concatenate([(_from_bits(bits[i : i + at_once], buckets) @ basis.T) @ whiten for i in range(0, len(bits), at_once)])
    target = np.array([[lang == name for name in names] for lang in languages], np.float64)
    share = target.mean(axis=0)
    balance = (1 / (len(names) * share))[target.argmax(axis=1)][:, None]  # every language counts alike
    gram = features.T @ (balance * features) + ridge * len(bits) * np.eye(features.shape[1]) / len(names)
    solved = np.linalg.solve(gram, features.T @ (balance * target))
    return LanguageModel(names, (basis.T @ (whiten @ solved)).astype(np.float32), buckets)


def training_sample(df: DataFrame, *, key: str, text: str, lang: str, where: Column, per_language: int, most_rows: int, buckets: int) -> tuple[np.ndarray, list[str]]:
    """(presence bits, languages) of about `per_language` rows of each language, drawn by a hash of the key.

    Only rows that satisfy `where` are counted or drawn. With so many languages that this
    would pass `most_rows`, each gives an equal part of `most_rows`, one row at least.
    """
    usable = df.select(quoted(key).alias("k"), quoted(text).cast("string").alias("t"), quoted(lang).cast("string").alias("l"))
    usable = usable.filter(where & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = usable.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_rows)
    wanted = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(most_rows) / F.count("*").over(Window.partitionBy(F.lit(0))))))
    shares = counts.select("l", (wanted / F.col("n")).alias("share"))  # a row a language, most_rows at most
    drawn = usable.join(F.broadcast(shares), "l").filter(F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1 << 30)) < F.col("share") * float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [presence_bits(t.as_py(), buckets) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), *batch.columns[1:]], ["bits", "l", "h"])

    rows = drawn.select("t", "l", F.xxhash64("k", "t").alias("h")).mapInArrow(run, "bits binary, l string, h long")
    table = rows.orderBy("h", "l").limit(2 * most_rows).toArrow()
    bits = np.array([np.frombuffer(b.as_buffer(), np.uint8) for b in table["bits"]], np.uint8).reshape(len(table), len(ORDERS) * buckets // 8)
    return bits, table["l"].to_pylist()


def train(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    where: Column | None = None,
    per_language: int = 400,
    most_rows: int = 20_000,
    landmarks: int = 256,
    ridge: float = 1e-2,
    buckets: int = BUCKETS,
) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows: about per_language rows of each language, about most_rows in all.

    `where` may use the columns k (key), t (text) and l (language); rows that it refuses have
    no influence, not even on how many rows are drawn. Every language with a usable row can be
    drawn. Rows of 8 KB each reach the driver, at most twice `most_rows`. Nulls of text or
    language, and texts without a letter, are not learned from; repeated rows are drawn
    together. Without labelled rows the model knows no language and predicts none.
    """
    bits, languages = training_sample(df, key=key, text=text, lang=lang, where=F.lit(True) if where is None else where, per_language=per_language, most_rows=most_rows, buckets=buckets)
    return fit(bits, languages, landmarks=landmarks, ridge=ridge, buckets=buckets)


def predict(df: DataFrame, model: LanguageModel, *, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", at_once: int = 64) -> DataFrame:
    """df with the predicted language of the whole text and a score from 0 to 1.

    A null text, one without a letter, and any text under an empty model are `und` with score 0. Columns of those
    names are replaced, all others kept whatever their names. Ties go to the language that sorts first; equal texts
    are predicted equally; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c not in (lang_pred, score)]
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, buckets = shared.value
        for batch in batches:
            best, sure = [], []
            asked, letters = batch.column(1), batch.column(2)
            for lo in range(0, len(batch), at_once):
                texts = [t.as_py() if ok.as_py() else "" for t, ok in zip(asked[lo : lo + at_once], letters[lo : lo + at_once])]
                if not languages:
                    best += [UNKNOWN] * len(texts)
                    sure += [0.0] * len(texts)
                    continue
                scores = presence_matrix(texts, buckets) @ weights
                for t, row in zip(texts, scores):
                    k = int(row.argmax())
                    known = bool(t)
                    best.append(languages[k] if known else UNKNOWN)
                    sure.append(float(min(1.0, max(0.0, row[k]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], ["row", "told", "sure"])

    slim = df.select(packed(keep).alias("row"), quoted(text).cast("string").alias("t"))
    slim = slim.withColumn("letters", F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False)))
    out = slim.mapInArrow(run, schema_with(slim, "row", "told string, sure double"))
    return out.select(*unpacked(keep), F.col("told").alias(lang_pred), F.col("sure").alias(score))
