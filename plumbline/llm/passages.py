"""Remove repeated passages by hashing lines and paragraphs.

A line is normalised to its words, with A-Z as a-z, one space between them. Every line with a word is a unit, and so is
every paragraph, a run of such lines up to a blank one. Units are grouped by a 128-bit digest over all documents; the
occurrence that comes first by document and place always stays. A passage is a stretch of a document, of ``passage``
words or more, whose lines have all come before, or a paragraph of that size that has, whatever its line breaks. Passages
go; single lines of fewer words are no passage and stay. Offsets count code points of the original text.

:func:`repeated_passages` is the plainer form: lines of ``min_words`` words, and with ``paragraphs`` runs of shorter ones,
each removed by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import shingles
from plumbline.llm.frames import map_batches, small_side, stored

MIN_WORDS = 8
#: Words of a passage that goes when it comes again.
PASSAGE = 50
_STARTS = np.ones(256, dtype=bool)
_STARTS[0x80:0xC0] = False


def _all_lines(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """text, line, begin and end in bytes, first and last word (exclusive) of every line of non-empty texts."""
    data, offsets = shingles.utf8(texts)
    _, _, starts, _ = found = shingles.words(texts, fold=True)
    full = np.flatnonzero(np.diff(offsets))
    cuts = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([offsets[full], cuts + 1])
    text = np.concatenate([full, np.searchsorted(offsets, cuts, side="right") - 1])
    # The empty line after a closing line break begins where the next text does.
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    inner = np.append(begin[1:], len(data))
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end = np.where(last, offsets[text + 1], inner - 1) if len(text) else begin
    line = np.arange(len(text)) - np.searchsorted(text, text)
    first, after = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    points = np.concatenate([[0], np.cumsum(_STARTS[data], dtype=np.int64)])
    base = points[offsets[text]]
    return text, line, points[begin] - base, points[end] - base, first, after, found[0]


def _digests(hashes: np.ndarray, first: np.ndarray, after: np.ndarray) -> dict[str, np.ndarray]:
    again = shingles.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return {
        "d1": shingles.spans(hashes, first, after).view(np.int64),
        "d2": shingles.spans(again, first, after).view(np.int64),
    }


def _lines(texts: pa.Array, min_words: int, paragraphs: bool) -> dict[str, np.ndarray]:
    """text, line, start, end, n_words, d1, d2 of all lines with enough words, or also of the runs of others."""
    text, line, begin, end, first, after, hashes = _all_lines(texts)
    count = after - first
    heads = tails = count >= max(1, min_words)
    if paragraphs:
        short = (count > 0) & ~heads
        goes_on = short[1:] & short[:-1] & (text[1:] == text[:-1])
        outside = np.zeros(min(1, len(count)), bool)
        heads = (count > 0) & ~np.append(outside, goes_on)
        tails = (count > 0) & ~np.append(goes_on, outside)
    begin, text, line, first = (x[heads] for x in (begin, text, line, first))
    end, after = end[tails], after[tails]
    found = {"text": text, "line": line, "start": begin, "end": end, "n_words": after - first}
    return found | _digests(hashes, first, after)


def _units(texts: pa.Array) -> dict[str, np.ndarray]:
    """All lines with a word, and after them the paragraphs of more than one line.

    ``unit`` numbers the lines of a text that have a word, ``block`` its paragraphs; ``n_lines`` is 1 for a line.
    """
    text, line, begin, end, first, after, hashes = _all_lines(texts)
    has = after > first
    text, line, begin, end, first, after = (x[has] for x in (text, line, begin, end, first, after))
    unit = np.arange(len(text)) - np.searchsorted(text, text)
    goes_on = (text[1:] == text[:-1]) & (line[1:] == line[:-1] + 1)
    outside = np.zeros(min(1, len(text)), bool)
    heads, tails = ~np.append(outside, goes_on), ~np.append(goes_on, outside)
    block = np.cumsum(heads)
    where_heads, where_tails = np.flatnonzero(heads), np.flatnonzero(tails)
    several = where_tails > where_heads
    top, tail = where_heads[several], where_tails[several]
    both = np.concatenate([np.arange(len(text)), top])
    stop = np.concatenate([np.arange(len(text)), tail])
    found = {
        "text": text[both],
        "line": line[both],
        "start": begin[both],
        "end": end[stop],
        "n_words": after[stop] - first[both],
        "unit": unit[both],
        "block": block[both],
        "n_lines": np.concatenate([np.ones(len(text), np.int64), unit[tail] - unit[top] + 1]),
    }
    return found | _digests(hashes, first[both], after[stop])


def _measured(docs: DataFrame, doc_id: str, text: str, names: tuple[str, ...], function) -> DataFrame:
    """row, doc_id and ``names`` of the units that ``function`` finds in an array of texts."""
    frame = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("t")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows, found = batch.column("t"), [], []
        for a, b in shingles.pieces(texts):
            found.append(function(texts.slice(a, b - a)))
            rows.append(found[-1]["text"] + a)
        rows = pa.array(np.concatenate(rows), pa.int64())
        return pa.record_batch(
            [batch.column("row").take(rows), batch.column("doc_id").take(rows)]
            + [pa.array(np.concatenate([f[n] for f in found]), pa.int64()) for n in names],
            names=["row", "doc_id", *names],
        )

    kind = dict(frame.dtypes)["doc_id"]
    return map_batches(frame, run, f"row long, doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def passages(
    docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", paragraphs: bool = False
) -> DataFrame:
    """All lines with enough words: row, doc_id, line, start, end, n_words and the digest d1, d2.

    With ``paragraphs`` also the runs of shorter lines, each with its first line's number.
    ``row`` tells rows of equal id apart. Null and empty texts have no lines.
    """
    names = ("line", "start", "end", "n_words", "d1", "d2")
    return _measured(docs, doc_id, text, names, lambda texts: _lines(texts, min_words, paragraphs))


def passage_units(docs: DataFrame, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit: doc_id, row, line, n_lines, start, end, n_words, digest, kept, kept_doc_id, kept_line.

    Units are the lines with a word (n_lines 1) and the paragraphs of more than one line, which begin at ``line``.
    ``kept`` is false for a unit whose words go: a repeated paragraph of ``passage`` words or more and the lines in it, and
    repeated lines in a stretch that has so many words together, blank lines between them aside. kept_doc_id and kept_line
    name the first occurrence of the unit's digest, its own for the first; order is by id (null ids last), then row and
    place. Equal words are equal units, in a line or a paragraph. Repeats inside one document count, rows of equal id are documents
    of their own. An empty table, null, empty and blank texts give no rows. ``passage=1`` removes every repeated unit.
    """
    names = ("line", "n_lines", "start", "end", "n_words", "unit", "block", "d1", "d2")
    found = stored(_measured(docs, doc_id, text, names, _units), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row", "start", "n_lines", "line")
    groups = (
        found.groupBy(F.col("d1").alias("g1"), F.col("d2").alias("g2"))
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("g1", "g2", "first")
    )
    joined = found.join(small_side(groups), (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")), "left")
    own = (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line")) & (F.col("n_lines") == F.col("first.n_lines"))
    joined = joined.withColumn("again", F.col("first").isNotNull() & ~F.coalesce(own, F.lit(True)))
    # A document's units meet once; every window below lies within that.
    whole = F.col("again") & (F.col("n_lines") > 1) & (F.col("n_words") >= passage)
    marked = joined.repartition("row").withColumn("whole", F.max(whole).over(Window.partitionBy("row", "block")))
    kind = [F.col("n_lines") > 1, F.col("again")]
    run = F.col("unit") - F.row_number().over(Window.partitionBy("row", *kind).orderBy("unit"))
    marked = marked.withColumn("run", run)
    stretch = F.sum("n_words").over(Window.partitionBy("row", *kind, "run"))
    gone = F.col("whole") | (F.col("again") & (stretch >= passage) & (F.col("n_lines") == 1))
    return marked.withColumn("gone", gone).select(
        "doc_id",
        "row",
        "line",
        "n_lines",
        "start",
        "end",
        "n_words",
        F.concat(*[F.lpad(F.lower(F.hex(d)), 16, "0") for d in ("d1", "d2")]).alias("digest"),
        (~F.col("gone")).alias("kept"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("kept_doc_id"),
        F.coalesce("first.line", "line").alias("kept_line"),
    )


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", paragraphs: bool = False
) -> DataFrame:
    """The occurrences to remove, with the one that stays: one row per removed line, or run of lines.

    doc_id, row, line, start, end, n_words, kept_doc_id, kept_line. The first occurrence is the one with
    the smallest id (null ids last), then row, then line; repeats inside one document count too. An
    empty table, null and empty texts give no rows. Groups of any size fold into one row per task before
    they move; only digests that occur twice join back.
    """
    found = stored(passages(docs, min_words, doc_id, text, paragraphs), "passages")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row", "line")
    groups = (
        found.groupBy(F.col("d1").alias("g1"), F.col("d2").alias("g2"))
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("g1", "g2", "first")
    )
    joined = found.join(groups, (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")))
    again = (F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line"))
    return joined.where(again).select(
        "doc_id",
        "row",
        "line",
        "start",
        "end",
        "n_words",
        F.col("first.id").alias("kept_doc_id"),
        F.col("first.line").alias("kept_line"),
    )


def without_passages(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    paragraphs: bool = False,
    removed: str = "removed",
) -> DataFrame:
    """``docs`` without the spans of :func:`repeated_passages`, which are kept as ``removed``; see :func:`without_repeats`."""
    spans = repeated_passages(docs, min_words, doc_id, text, paragraphs)
    return _cut_out(docs, spans, text, removed)


def without_repeats(
    docs: DataFrame, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text", removed: str = "removed"
) -> DataFrame:
    """``docs`` with the passages that :func:`passage_units` does not keep cut from their texts.

    Each line goes with the line break before it. The column ``removed`` holds the original offsets, an array of
    (start, end), a row's own, empty where nothing went; a column of that name that ``docs`` has already gives way
    to it. Null texts stay null. The scan has to give rows the same numbers each time, as a table does.
    """
    spans = passage_units(docs, passage, doc_id, text).where("NOT kept AND n_lines = 1")
    return _cut_out(docs, spans, text, removed)


def _cut_out(docs: DataFrame, spans: DataFrame, text: str, removed: str) -> DataFrame:
    cut = spans.groupBy(F.col("row").alias("__at")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut")
    )
    plain = docs.drop(removed)
    marked = plain.withColumn("__row", F.monotonically_increasing_id())
    marked = marked.join(small_side(cut), F.col("__row") == F.col("__at"), "left").drop("__row", "__at")
    names = [f"c{i}" for i in range(len(plain.columns))]
    at = plain.columns.index(text)
    none = F.array().cast("array<struct<start:long,end:long>>")
    frame = marked.toDF(*names, "cut").withColumn("cut", F.coalesce("cut", none))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value, gone in zip(batch.column(at).to_pylist(), batch.column("cut").to_pylist(), strict=True):
            if gone:
                parts, here = [], 0
                for span in gone:
                    parts.append(value[here : max(here, span["start"] - 1)])
                    here = span["end"]
                value = "".join([*parts, value[here:]]).removeprefix("\n" if gone[0]["start"] == 0 else "")
            out.append(value)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return map_batches(frame, run, frame.schema).toDF(*plain.columns, removed)
