"""Token counts by separator scan over flat token files.

A flat token file is nothing but token ids one after the other, an end-of-document id after
each document, and no index. It is read in blocks of a fixed number of ids, each block is
searched for the end-of-document id at once, and a prefix scan over the blocks' summaries
(ids, separators, ids after the last separator) stitches documents that cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, quoted

#: Ids in a block.
BLOCK = 1 << 16

#: Split pattern of the byte-level vocabularies (a fixed value that belongs to them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK_SCHEMA = "file string, block long, ids binary, doc_ids array<string>"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-pair vocabulary file: base64 of the token, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def token_blocks(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", pattern: str = PATTERN, block: int = BLOCK) -> DataFrame:
    """(file, block, ids, doc_ids): the documents of each partition as one flat file, cut into blocks without regard to documents.

    doc_ids lists the documents written while the block was filled; their order is the file's.
    The end-of-document id is one above the vocabulary's largest. A null text has no tokens.
    The vocabulary is read on the driver and broadcast (some MB, whatever the data).
    """
    ranks = load_ranks(vocabulary)
    eod = max(ranks.values()) + 1
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        file, number, held, ids, names = str(TaskContext.get().partitionId()), 0, 0, [], []

        def cut(flat: np.ndarray) -> pa.RecordBatch:
            nonlocal number, names
            row = [pa.array([file]), pa.array([number], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([names], pa.list_(pa.string()))]
            number, names = number + 1, []
            return pa.RecordBatch.from_arrays(row, ["file", "block", "ids", "doc_ids"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                own = encode(body.as_py() or "")
                ids.append(np.array([*own, eod], np.uint32))
                names.append(name.as_py())
                held += len(own) + 1
                if held >= block:
                    flat = np.concatenate(ids)
                    for lo in range(0, held - block + 1, block):
                        yield cut(flat[lo : lo + block])
                    held %= block
                    ids = [flat[len(flat) - held :].copy()]
        if held or names:
            yield cut(np.concatenate(ids))

    return docs.select(quoted(key).cast("string").alias("k"), quoted(text).cast("string").alias("t")).mapInArrow(run, BLOCK_SCHEMA)


def read_token_files(spark: SparkSession, path: str, *, dtype: str = "<u4", block: int = BLOCK) -> DataFrame:
    """The same blocks from flat token files (each below Spark's limit of 2 GB for a binary file); doc_ids are null."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = memoryview(content.as_buffer())
                for number, lo in enumerate(range(0, len(raw), block * width)):
                    part = np.frombuffer(raw[lo : lo + block * width], dtype).astype(np.uint32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([number], pa.int64()), pa.array([part], pa.binary()), pa.array([None], pa.list_(pa.string()))], ["file", "block", "ids", "doc_ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCK_SCHEMA)


def scan(blocks: DataFrame, eod: int) -> DataFrame:
    """Each block's summary: n (ids), n_seps, last (place after its last separator), lengths (ids before its first separator, then between separators), doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, seps, lasts, lengths = [], [], [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), np.uint32)
                ends = np.flatnonzero(ids == eod)
                ns.append(len(ids))
                seps.append(len(ends))
                lasts.append(int(ends[-1]) + 1 if len(ends) else None)
                lengths.append(np.diff(ends, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(seps, pa.int64()), pa.array(lasts, pa.int64()), pa.array(lengths, pa.list_(pa.int64())), batch.column(3)],
                ["file", "block", "n", "n_seps", "last", "lengths", "doc_ids"],
            )

    return blocks.mapInArrow(run, "file string, block long, n long, n_seps long, last long, lengths array<long>, doc_ids array<string>")


def document_lengths(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, separators not counted; ids after a file's last separator are a document of their own."""
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    rows = scanned.select("file", "block", "n", "n_seps", "last", "lengths")
    rows = rows.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("ordinal", F.coalesce(F.sum("n_seps").over(before), F.lit(0)))
    rows = rows.withColumn("open_from", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(0)))
    rows = rows.withColumn("final", F.lead("block").over(by_file).isNull())
    carry = F.col("start") - F.col("open_from")
    closed = F.transform("lengths", lambda x, i: F.when(i == 0, x + carry).otherwise(x))
    rest = F.col("start") + F.col("n") - F.coalesce(F.col("start") + F.col("last"), F.col("open_from"))
    every = F.concat(closed, F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return rows.select("file", "ordinal", F.posexplode(every).alias("i", "n_tokens")).select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens")


def _named(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id) of the documents in their files' order."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = scanned.select("file", "block", "doc_ids").withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    return rows.select("file", F.col("first"), F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def count_tokens(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_tokens. Null and empty texts have 0; repeated and null keys keep their rows.

    The blocks go from the tokeniser to the scan without being stored; the summaries are
    written once (some bytes a document) and read twice.
    """
    eod = max(load_ranks(vocabulary).values()) + 1
    kind = docs.schema[key].dataType
    scanned = materialize(scan(token_blocks(docs, vocabulary, key=key, text=text, block=block), eod))
    told = _named(scanned).join(document_lengths(scanned), ["file", "ordinal"])
    return told.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens")
