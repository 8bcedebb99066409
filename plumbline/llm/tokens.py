"""Token counts of whole texts, huge ones in overlapping chunks that are spliced again.

A text of up to ``chunk`` code points is encoded whole. A longer one is cut into chunks that overlap,
and the chunks, not the documents, are dealt over the tasks. Every chunk is encoded with offsets. The
tokenizer cuts a text into words by an expression that never looks back, and merges inside words only:
where a word starts in the encodings of two neighbouring chunks, far enough from the end of the first,
both go on alike, so the count may pass from one to the other there. Such a place is a stable common
boundary. A pair of chunks without one, as inside a word longer than the overlap, has its document cut
again with longer chunks and a wider overlap until all pairs splice or one chunk holds the document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stored
from plumbline.llm.vocabulary import Encoder, encoder

#: Code points of a chunk, code points that neighbours share, and how much both grow where a splice fails.
CHUNK, OVERLAP, WIDEN = 32_768, 1_024, 4
#: Code points before the end of a chunk that the end may change: a contraction looks two ahead.
MARGIN = 4
#: Bytes of texts that are encoded at a time.
PIECE_BYTES = 1 << 20


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE_BYTES; a longer text is a range of its own."""
    start = 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + PIECE_BYTES, side="right")) - 1)
        yield start, stop
        start = stop


def word_starts(words: list[int | None], offsets: list[tuple[int, int]], low: int, high: int) -> dict[int, int]:
    """Where words start between two offsets, and how many tokens of the chunk come before each."""
    found: dict[int, int] = {}
    for at in range(bisect_left(offsets, low, key=itemgetter(0)), len(offsets)):
        start = offsets[at][0]
        if start > high:
            break
        # Tokens that share a code point, or go on with a word, are no start. Special tokens have no word.
        if not at or start >= offsets[at - 1][1] and (words[at] is None or words[at] != words[at - 1]):
            found.setdefault(start, at)
    return found


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, n_chunks of the last cut.

    ``tokenizer`` is the path of a byte-level tokenizer, the same on all executors. Its special strings
    inside texts count as it reads them by default; none is added. A null text is empty: no bytes and no
    tokens, one chunk. Rows of equal id, null ids and equal texts are counted one by one, other columns
    are not read. Only the chunks of texts longer than ``chunk`` code points are shuffled.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("overlap must be positive and at most half of chunk")
    known = Encoder(tokenizer)
    if not known.byte_level:
        raise ValueError(f"{tokenizer} is not a byte-level tokenizer without normalizer and prefix")
    margin = max([MARGIN, *(len(s) for s in known.special)])
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(frame.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of short texts; a long one keeps its text and has no count."""
        ids = encoder(tokenizer).ids
        for batch in batches:
            texts, doc = batch.column("t"), batch.column("doc_id")
            lengths = pc.binary_length(texts)
            long = pc.greater(pc.utf8_length(texts), chunk)
            for a, b in _pieces(lengths.to_numpy(zero_copy_only=False)):
                values, flags = texts.slice(a, b - a).to_pylist(), long.slice(a, b - a).to_pylist()
                short = [v for v, f in zip(values, flags, strict=True) if not f]
                counts = iter([len(i) for i in ids(short)])
                yield pa.record_batch(
                    [
                        doc.slice(a, b - a),
                        lengths.slice(a, b - a).cast(pa.int64()),
                        pa.array([None if f else next(counts) for f in flags], pa.int64()),
                        pa.array([v if f else None for v, f in zip(values, flags, strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "t"],
                )

    first = frame.mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long, t string")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "counted")
    done = first.where("t is null").select("doc_id", "n_bytes", "n_tokens", F.lit(1).cast("long").alias("n_chunks"))
    left = first.where("t is not null").select("row", "t")
    spliced = []
    while not left.isEmpty():
        found = stored(_spliced(left, tokenizer, chunk, overlap, margin), "spliced")
        spliced.append(found.where("missing = 0"))
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        left = left.join(found.where("missing > 0").select("row"), "row", "left_semi")
    for found in spliced:
        long = first.where("t is not null").select("doc_id", "n_bytes", F.col("row").alias("at"))
        joined = found.join(long, F.col("row") == F.col("at"))
        done = done.unionByName(joined.select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
    return done


def _spliced(texts: DataFrame, tokenizer: str, chunk: int, overlap: int, margin: int) -> DataFrame:
    """row, n_tokens, n_chunks, missing: the counts of texts (row, t), and how many pairs of chunks did not splice.

    With p the splice of chunks k and k + 1, a document has the tokens of its last chunk and, for each
    pair, those before p in chunk k less those before p in chunk k + 1. So pairs add up in any order.
    """
    step = chunk - overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("t"), strict=True):
                value = text.as_py()
                last = max(0, -(-(len(value) - chunk) // step))
                for k in range(last + 1):
                    columns = [[row], [k], [last], [value[k * step : k * step + chunk]]]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "k", "last", "c"]
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk, its part in the pairs before and after it: starts of words and tokens before them."""
        whole = encoder(tokenizer).whole
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for row, k, last, text in zip(*columns, batch.column("c"), strict=True):
                found = whole.encode(text.as_py(), add_special_tokens=False)
                tokens, out = (found.word_ids, found.offsets), []
                if k:
                    out.append((k - 1, 1, word_starts(*tokens, 0, overlap - margin)))
                if k < last:
                    out.append((k, 0, {p - step: n for p, n in word_starts(*tokens, step, chunk - margin).items()}))
                pairs = [(p, side, list(s), list(s.values()), None) for p, side, s in out]
                if k == last:
                    pairs.append((last, 2, [], [], len(found)))
                names = ["row", "last", "pair", "side", "starts", "before", "total"]
                columns_out = [[row] * len(pairs), [last] * len(pairs), *map(list, zip(*pairs, strict=True))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns_out, kinds, strict=True)], names=names)

    schema = "row long, last long, pair long, side int, starts array<int>, before array<long>, total long"
    parts = (
        texts.mapInArrow(cut, "row long, k long, last long, c string")
        .repartition(F.col("row"), F.col("k"))
        .mapInArrow(encode, schema)
    )

    def of(side: int, column: str) -> F.Column:
        return F.first(F.when(F.col("side") == side, F.col(column)), ignorenulls=True).alias(f"{column}{side}")

    pairs = parts.groupBy("row", "last", "pair").agg(
        *[of(side, column) for side in (0, 1) for column in ("starts", "before")], F.max("total").alias("total")
    )
    at = F.array_min(F.array_intersect("starts0", "starts1"))
    tokens = F.expr(
        "element_at(before0, int(array_position(starts0, at))) - element_at(before1, int(array_position(starts1, at)))"
    )
    pairs = pairs.withColumn("at", at).withColumn("delta", F.when(F.col("at").isNotNull(), tokens))
    return pairs.groupBy("row").agg(
        F.sum(F.coalesce("total", "delta")).alias("n_tokens"),
        F.max(F.col("last") + 1).alias("n_chunks"),
        F.sum((F.coalesce("total", "delta").isNull()).cast("long")).alias("missing"),
    )
