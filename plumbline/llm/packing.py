"""Pack documents by the binary digits of their lengths.

A document of T tokens becomes floor(T / limit) pieces of the limit and one piece for each binary
digit of the rest. Every piece is a sequence of its own whose length is a power of two, so no
sequence crosses documents, none has padding, and sequences of equal length share a bucket.

Tokenizing dominates; see :mod:`plumbline.llm.vocabulary`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.vocabulary import encoder

LIMIT = 2048
END_ID = 1


def binary_lengths(total: int, limit: int = LIMIT) -> list[int]:
    """``limit`` as often as it fits, then the powers of two of the rest, the largest first."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    limit: int = LIMIT,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    ``limit`` is a power of two. ``ids`` holds little-endian unsigned 32-bit ids and ends, with the
    document, in ``end_id``. A null text is empty: its one piece is the end id. Rows of equal id are
    packed one by one, other columns are not read. Special strings inside a text are encoded as the tokenizer does by
    default. Each piece fills its sequence, so offset is 0. Nothing is shuffled; sequence ids follow the partitions of the scan, and a task that runs again gives the same ids.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).packed
        for batch in batches:
            texts = batch.column("text")
            for a, b in shingles.pieces(texts):
                rows, starts, lengths, parts, totals = [], [], [], [], []
                for row, ids in enumerate(encode([t or "" for t in texts.slice(a, b - a).to_pylist()]), a):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length in binary_lengths(total, limit):
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        parts.append(ids[4 * start : 4 * (start + length)])
                        totals.append(total)
                        start += length
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(parts, pa.binary()),
                        pa.array(totals, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    kind = dict(frame.dtypes)["doc_id"]
    pieces = frame.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Write the sequences in one folder for each length, ``bucket=<length>``, so that a batch holds equal lengths.

    Returns what was written. There are as many buckets as powers of two up to the limit.
    """
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
    return pieces.sparkSession.read.parquet(path)
