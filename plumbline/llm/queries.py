"""The operators of this package as queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import Catalog
from plumbline.llm import (
    jaccard,
    language,
    lines,
    merkle,
    mixing,
    packing,
    passages,
    quality,
    rules,
    tokens,
    toxicity,
    vectors,
    whitening,
)
from plumbline.llm.frames import held_out, read

catalog = Catalog()

SQL_WORD = r"[^\x20\x09-\x0D]+"


def queries():
    return dict(catalog.queries)


def oracles() -> dict[str, str]:
    return dict(catalog.oracles)


@catalog.query(
    "op3_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SQL_WORD}')) AS word,
                 generate_subscripts(regexp_extract_all(text, '{SQL_WORD}'), 1) AS pos FROM d),
    g AS (SELECT doc_id, pos, word,
                 lead(word, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS w2,
                 lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3 FROM w),
    c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{SQL_WORD}') GROUP BY doc_id),
    a AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
                 length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
          FROM d LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
    f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
                 + 4 * (10 * n_symbols > 2 * n_words)::BIGINT
                 + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
                 + 16 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
                 + 32 * (2 * n_capitals > n_letters)::BIGINT AS failures FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
    """,
)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(rules.measure(read(spark, sf_dir, "documents")))
    judged = rules.apply_policy(rules.apply_policy(entries, rules.BASE, "passed"), rules.CURRENT)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col("passed")).alias("base_failed"),
        "kept",
        "failures",
    )


@catalog.query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@catalog.query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@catalog.query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@catalog.query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@catalog.query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_start",
        "worst_end",
        "worst_score",
    )


@catalog.query(
    "op10_substring_dedup",
    rf"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    p AS (
        SELECT doc_id, line, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(raw)::BIGINT AS size,
               regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '{SQL_WORD}') AS words FROM l),
    w AS (SELECT *, row_number() OVER o - 1 AS unit, line - row_number() OVER o AS block FROM p WHERE len(words) > 0
          WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
    u AS (SELECT doc_id, line, 1::BIGINT AS n_lines, start, start + size AS "end", len(words)::BIGINT AS n_words,
                 array_to_string(words, ' ') AS content, unit, block FROM w
          UNION ALL
          SELECT doc_id, min(line), count(*), min(start), max(start + size), sum(len(words))::BIGINT,
                 string_agg(array_to_string(words, ' '), ' ' ORDER BY line), min(unit), block
          FROM w GROUP BY doc_id, block HAVING count(*) > 1),
    r AS (SELECT *, row_number() OVER f > 1 AS again, first_value(doc_id) OVER f AS kept_doc_id,
                 first_value(line) OVER f AS kept_line FROM u
          WINDOW f AS (PARTITION BY content ORDER BY doc_id, start, n_lines)),
    b AS (SELECT *, bool_or(again AND n_lines > 1 AND n_words >= 50) OVER (PARTITION BY doc_id, block) AS whole,
                 unit - row_number() OVER (PARTITION BY doc_id, n_lines > 1, again ORDER BY unit) AS run FROM r),
    s AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, n_lines > 1, again, run) AS stretch FROM b)
    SELECT doc_id, line, n_lines, start, "end", n_words,
           NOT (whole OR (again AND n_lines = 1 AND stretch >= 50)) AS kept, kept_doc_id, kept_line FROM s
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_units(read(spark, sf_dir, "documents")).drop("row", "digest")


@catalog.query(
    "op10_paragraph_dedup",
    rf"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    p AS (
        SELECT doc_id, line_no,
               coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at,
               length(line)::BIGINT AS size,
               regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '{SQL_WORD}') AS words FROM l),
    b AS (SELECT *, CASE WHEN len(words) BETWEEN 1 AND 7
                          AND lag(len(words)) OVER (PARTITION BY doc_id ORDER BY line_no) BETWEEN 1 AND 7
                         THEN 0 ELSE 1 END AS head FROM p),
    g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b),
    u AS (SELECT doc_id, min(line_no) AS line_no, min(start_at) AS start_at, max(start_at + size) AS end_at,
                 sum(len(words))::BIGINT AS n_words,
                 string_agg(array_to_string(words, ' '), ' ' ORDER BY line_no) AS unit
          FROM g WHERE len(words) > 0 GROUP BY doc_id, run),
    r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS kept_doc_id,
                 first_value(line_no) OVER w AS kept_line
          FROM u WINDOW w AS (PARTITION BY unit ORDER BY doc_id, line_no))
    SELECT doc_id, line_no AS line, start_at AS start, end_at AS "end", n_words, kept_doc_id, kept_line
    FROM r WHERE place > 1
    """,
)
def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines of less than eight words are units as well as the longer lines."""
    return passages.repeated_passages(read(spark, sf_dir, "documents"), paragraphs=True).drop("row")


@catalog.query(
    "op1_ngram_jaccard",
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '{SQL_WORD}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
               ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
    r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
    """,
)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(read(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@catalog.query(
    "op6_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
          AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          AND list_cosine_similarity(a.x, b.x) >= 0.98),
    r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
    d AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM c LEFT JOIN d USING (vec_id)
    """,
)
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@catalog.query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fuzzy_lines(read(spark, sf_dir, "documents")).drop("row")


@catalog.query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened_components(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def _merkle_sql(levels: int = 8) -> str:
    """The trees level by level: up to 16^levels rows of a source and as many sources."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"

    # crc32 bit by bit: 3988292384 is the reversed polynomial.
    step = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    octets = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: {step}), 4294967295)"
    sql = f"""
    WITH l AS (
        SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
               CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS bad FROM documents),
    p0 AS (SELECT r, coalesce(source, '') AS s, source IS NOT NULL AS named, leaf AS d, bad AS f, '' AS proof,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l)"""
    for k in range(1, 2 * levels + 1):
        below = f"p{k - 1}"
        if k == levels + 1:
            below = "q"
            sql += f""",
    q AS (SELECT r, '' AS s, true AS named, d, f, proof, d AS sub, dense_rank() OVER (ORDER BY named, s) - 1 AS place FROM p{levels})"""
        sub = ", sub" if k > levels else ""
        # A node is one row for each leaf below it; siblings are the digests of the other places of the run.
        sql += f""",
    n{k} AS MATERIALIZED (SELECT s, named, place // 16 AS run, string_agg(d, '' ORDER BY place) AS run_d, list(d ORDER BY place) AS ds, max(many) AS many
            FROM (SELECT *, max(place) OVER (PARTITION BY s, named) > 0 AS many FROM (SELECT DISTINCT s, named, place, d FROM {below}))
            GROUP BY s, named, place // 16),
    p{k} AS MATERIALIZED (SELECT r, b.s, b.named, CASE WHEN many THEN sha256(run_d) ELSE d END AS d,
            CASE WHEN many THEN sha256(array_to_string(ds[1:place % 16], '') || f || array_to_string(ds[place % 16 + 2:], '')) ELSE f END AS f,
            CASE WHEN many THEN proof || array_to_string(ds[1:place % 16], '') || array_to_string(ds[place % 16 + 2:], '') ELSE proof END AS proof,
            CASE WHEN many THEN place // 16 ELSE place END AS place{sub}
            FROM {below} b JOIN n{k} n ON b.s = n.s AND b.named = n.named AND b.place // 16 = n.run)"""
    return sql + f"""
    SELECT doc_id, leaf, sub AS subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified
    FROM p{2 * levels} JOIN l USING (r)"""


@catalog.query("op12_merkle_manifest", _merkle_sql(4))
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))
    altered = [*(F.col(f) for f in merkle.FIELDS if f != "text"), text]
    return merkle.climb(merkle.build(read(spark, sf_dir, "documents"), altered=altered))


@catalog.query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "n_chunks")
