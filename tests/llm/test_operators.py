import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    jaccard,
    language,
    lines,
    mixing,
    packing,
    passages,
    quality,
    rules,
    shingles,
    toxicity,
    vectors,
)
from plumbline.llm.components import connected
from tests.llm.fixtures import FOLD, WORD, components, frame, odd_rows, prose, word_sets

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _near(seed, words, changes, base=None):
    rng = random.Random(seed)
    out = (base or prose(seed, words)).split(" ")
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"q{rng.randrange(10**9)}"
    return " ".join(out)


# ---- shingles ---------------------------------------------------------------------------------


def test_words_of_slices_and_pieces(monkeypatch):
    texts = [prose(i, 20) + "\n\té È" for i in range(30)] + [None, "", " a", "B ", "a b"]
    monkeypatch.setattr(shingles, "PIECE_BYTES", 300)
    whole = shingles.words(pa.array(texts), fold=True)
    hashes = []
    for a, b in shingles.pieces(pa.array(texts)):
        found, before, starts, ends = shingles.words(pa.array(texts).slice(a, b - a), fold=True)
        hashes.append(found)
        data, _ = shingles.utf8(pa.array(texts).slice(a, b - a))
        expected = [w.encode() for t in texts[a:b] for w in WORD.findall(t or "")]
        assert [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)] == expected
    assert np.array_equal(np.concatenate(hashes), whole[0])


# ---- components -------------------------------------------------------------------------------


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, x) for x in range(101, 160)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: Jaccard join --------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, size, percent):
    base = prose(1, 120)
    rows = [(i, prose(i, 20 + i)) for i in range(30)]
    rows += [(100 + i, _near(i, 0, i % 7, base)) for i in range(40)]
    rows += [(200 + i, base + " " + _near(300 + i, 0, 2, base).upper()) for i in range(12)]
    rows += [(300, base), (301, base.upper()), (302, "a b"), (303, "A  b"), (304, "b a")]
    rows = [(*r, "x", "s", 0) for r in rows] + odd_rows()
    # Small blocks, so that large tiles and groups are split.
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "GROUP_TILE", 5)
    sets = [word_sets(r[1], size) for r in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    expected = components(rows, links, [r[0] for r in rows])
    found = jaccard.jaccard_components(frame(spark, rows), size, percent).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    assert got == Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, expected, strict=True))


def test_one_near_copy_stays(spark):
    base = prose(4, 200)
    rows = [(5, base), (3, base + " end"), (9, base), (7, prose(8, 50)), (1, None), (2, "")]
    kept = jaccard.without_near_copies(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_bitmap_never_rules_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (3, 50, 900, 5000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for change in (0, n // 20, n // 10):
            other = np.unique(np.concatenate([keys[change:], rng.integers(0, 2**63, change, dtype=np.uint64)]))
            both = len(np.intersect1d(keys, other))
            if 100 * both < 80 * (len(keys) + len(other) - both):
                continue
            sizes = np.sort([len(keys), len(other)])
            pairs = list(jaccard._near(np.zeros(2), sizes, [jaccard._bitmap(keys), jaccard._bitmap(other)], 80))
            assert sum(len(a) for a, _ in pairs) == 1


# ---- 2: quality -------------------------------------------------------------------------------


def _labelled(spark, rows, column):
    schema = f"doc_id long, {column} int"
    return spark.createDataFrame(rows, schema)


def test_quality_separates_junk_and_takes_odd_rows(spark):
    rows, labels = [], []
    for i in range(300):
        junk = i % 4 == 0
        words = prose(i, 60 + i % 40)
        text = re.sub(r"(\w) ", r"\1### ", words) if junk and i % 8 else words.upper() + "!!" if junk else words
        rows.append((i, text, "x", "s", 0))
        labels.append((i, 0 if junk else 1))
    docs = frame(spark, rows + odd_rows())
    scored = quality.score_quality(docs, _labelled(spark, [*labels, (None, 1), (4000, None)], "quality")).collect()
    assert len(scored) == 310
    known = dict(labels)
    held = [(r["score"], known[r["doc_id"]]) for r in scored if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and sum((s >= 0.3) == bool(y) for s, y in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_quality_without_labels_is_even(spark):
    docs = frame(spark, [(1, "a b", "x", "s", 3)])
    assert [r["score"] for r in quality.score_quality(docs, _labelled(spark, [], "quality")).collect()] == [0.5]
    empty = frame(spark, [])
    assert quality.score_quality(empty, _labelled(spark, [(1, 1)], "quality")).count() == 0


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    means, covs = rng.normal(size=(2, 3)), np.array([np.diag([1.0, 2, 3]), np.eye(3) + 0.5])
    factors = np.linalg.cholesky(covs)
    model = quality.Discriminant(means, factors, -np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1))
    x = rng.normal(size=(5, 3))
    logs = [
        -0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.log(np.linalg.det(c))
        for m, c in zip(means, covs, strict=True)
    ]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


# ---- 3: rules ---------------------------------------------------------------------------------


def _measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + s for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for s in range(3)}
    full = [ln for ln in text.split("\n") if WORD.search(ln)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(full),
        "n_dup_lines": len(full) - len(set(full)),
        "n_repeat_words": len(covered),
        "n_letters": len(re.findall("[A-Za-z]", text)),
        "n_capitals": len(re.findall("[A-Z]", text)),
    }


def test_rules_measure_like_plain_python(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PIECE_BYTES", 2000)
    rows = [(i, prose(i, 40) + "\n" + "same line\nsame line \nsame line\n\n" * (i % 3) + prose(i, 20), "x", "s", 0) for i in range(25)]
    rows += [(90, "a b c a b c d\r\n#é*|\x0b<>\n", "x", "s", 0), (91, "\n\n", "x", "s", 0)] + odd_rows()
    found = rules.measure(frame(spark, rows)).collect()
    got = Counter(tuple(r) for r in found)
    assert got == Counter((r[0], *(_measured(r[1])[m] for m in rules.MEASURES)) for r in rows)


def test_policies_and_ablations_read_the_ledger(spark):
    rows = [(1, prose(1, 80)), (2, "few words"), (3, prose(2, 30).upper()), (4, "x# " * 200), (5, None)]
    entries = rules.ledger(rules.measure(frame(spark, rows)))
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(entries, rules.CURRENT).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    base = {r["doc_id"]: r["kept"] for r in rules.apply_policy(entries, rules.BASE).collect()}
    assert base == {1: True, 2: False, 3: False, 4: False, 5: False}
    costs = {r["rule"]: r for r in rules.ablations(entries, rules.CURRENT).collect()}
    assert costs["few_words"]["failed"] == 3 and costs["few_words"]["failed_alone"] == 2
    assert costs["few_words"]["kept_without"] == 3 and costs["few_words"]["documents"] == 5
    assert rules.ablations(rules.ledger(rules.measure(frame(spark, []))), rules.BASE).first()["kept_without"] == 0


# ---- 4: packing -------------------------------------------------------------------------------


def test_pieces_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    texts = ["", " ", "a  b", " lead", "trail ", "x\n y z\n", "it's fine, don't.", "tab\t x", "é, è. ü,b", "3.5, 4.", "\0 x y", None]
    rows = [(i, t, "x", "s", 0) for i, t in enumerate([*texts, *(prose(i, 700, "abcdeé,.'") for i in range(6))])]
    rows += odd_rows()
    pieces = packing.pack_documents(frame(spark, rows), TOKENIZER, limit=256).collect()
    expected = Counter(
        (r[0], np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows
    )
    assert all(p["length"] & (p["length"] - 1) == 0 and p["length"] <= 256 for p in pieces)
    assert all(p["offset"] == 0 and len(p["ids"]) == 4 * p["length"] for p in pieces)
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    # Sequence ids follow the scan, so the pieces of a document come in a row.
    got, held, at = Counter(), b"", 0
    for p in sorted(pieces, key=lambda p: p["sequence_id"]):
        assert p["start"] == at
        held, at = held + bytes(p["ids"]), at + p["length"]
        if at == p["doc_tokens"]:
            got[(p["doc_id"], held)] += 1
            held, at = b"", 0
    assert got == expected


def test_binary_lengths():
    assert packing.binary_lengths(2048 * 2 + 11) == [2048, 2048, 8, 2, 1]
    with pytest.raises(ValueError, match="power"):
        packing.pack_documents(None, TOKENIZER, limit=100)


def test_buckets_hold_equal_lengths(spark, folder):
    rows = [(i, prose(i, 40 + i), "x", "s", 0) for i in range(20)]
    pieces = packing.pack_documents(frame(spark, rows), TOKENIZER, limit=64)
    written = packing.write_buckets(pieces, f"{folder}/buckets")
    assert written.count() == pieces.count() and written.where("bucket <> length").isEmpty()


# ---- 5: language ------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éèàbc"}
    rows = [(i, prose(i, 12, letters[n]), n, "s", 0) for i in range(150) for n in [sorted(letters)[i % 3]]]
    found = {r["doc_id"]: r for r in language.identify(frame(spark, rows + odd_rows()[2:])).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(found[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert {found[i]["lang_pred"] for i in (5001, 5002, 5003, 5007)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_without_anything_to_learn(spark):
    rows = [(1, "text", None, "s", 0), (2, None, "x", "s", 0)]
    assert {r["lang_pred"] for r in language.identify(frame(spark, rows)).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


# ---- 6: vectors -------------------------------------------------------------------------------


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(260, 16))
    points[100:180] = points[0] + 0.03 * rng.normal(size=(80, 16))
    points[180:220] = points[1:41] + 0.1 * rng.normal(size=(40, 16))
    rows = [(i, [float(v) for v in p.astype(np.float32)], i % 2 if i < 100 else 0) for i, p in enumerate(points)]
    rows += [(400, rows[5][1], rows[5][2]), (400, rows[5][1], rows[5][2]), (401, rows[6][1], None), (402, None, 0)]
    rows += [(403, [0.0] * 16, 0), (404, [float("nan")] * 16, 0), (405, [None, 1.0], 0), (406, [float("inf"), 1.0], 0)]
    rows += [(407, [1.0, 0.0], 0), (408, [2.0, 0.0], 0), (409, [], 0), (None, [3.0, 0.0], 0), (410, [1e30, 0.0], 0)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(np.asarray(v, np.float32), np.float64)
        return v / np.linalg.norm(v)

    units = [unit(r[1]) for r in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] is not None
        and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98
    ]
    degree = Counter(x for link in links for x in link)
    tops = components(rows, links, [r[0] for r in rows])
    expected = Counter((r[0], degree[i], tops[i]) for i, r in enumerate(rows))
    found = vectors.near_vectors(frame_, leaf=32, sample=200).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["component_id"] is not None)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(empty).count() == 0


# ---- 7: lines ---------------------------------------------------------------------------------


def _line_sets(text):
    out = []
    for at, raw in enumerate((text or "").split("\n")):
        norm = raw.strip(" \t\r\x0b\x0c").lower()
        if norm:
            size = lines.SIZE
            out.append((at, frozenset(norm[i : i + size] for i in range(max(1, len(norm) - size + 1)))))
    return out


def test_similar_lines_equal_brute_force(spark):
    base = [prose(i, 40) for i in range(6)]
    rows = [(i, "\n".join([_near(i, 0, i % 2, base[i % 6]), prose(900 + i, 12), "", "Shared line here. "])) for i in range(24)]
    rows = [(*r, "x", "s", 0) for r in rows] + [r for r in odd_rows() if r[0] not in (5005, 5006)]
    units = [(d, at, s) for d, r in enumerate(rows) for at, s in _line_sets(r[1])]
    links = [
        (i, j)
        for i in range(len(units))
        for j in range(i)
        if 100 * len(units[i][2] & units[j][2]) >= lines.PERCENT * len(units[i][2] | units[j][2])
    ]
    order = {(d, at): ((rows[d][0] is None, rows[d][0] or 0, d, at)) for d, at, _ in units}
    tops = components(units, links, [order[(d, at)] for d, at, _ in units])
    expected = Counter((rows[d][0], at, tops[i] == order[(d, at)]) for i, (d, at, _) in enumerate(units))
    found = lines.fuzzy_lines(frame(spark, rows).coalesce(1)).collect()
    assert Counter((r["doc_id"], r["line"], r["kept"]) for r in found) == expected


def test_every_pair_of_a_large_bucket_is_compared(spark, monkeypatch):
    """Several hundred variants in one bucket, in clusters that hubs hardly meet, with small tiles and large ones."""
    rng = random.Random(5)
    texts = []
    for cluster in range(80):
        words = prose(3000 + cluster, rng.choice((6, 14, 40))).split(" ")
        for _ in range(rng.choice((1, 5, 6))):
            varied = list(words)
            varied[rng.randrange(len(words))] = rng.choice(("", "x", "other"))
            texts.append(" ".join(varied))
    texts = sorted({t.strip() for t in texts})
    sets = [_line_sets(t)[0][1] for t in texts]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= lines.PERCENT * len(sets[i] | sets[j])
    ]
    expected = Counter(Counter(components(texts, links, list(range(len(texts))))).values())
    monkeypatch.setattr(lines, "signatures", lambda units, size: units.groupBy("node").agg(F.min("at").alias("at"), F.array(F.lit(7).cast("long")).alias("bands")))
    occurrences = lines.line_occurrences(frame(spark, list(enumerate(texts))))
    for tile in (lines.TILE, 60):
        monkeypatch.setattr(lines, "TILE", tile)
        found = Counter(r["count"] for r in lines.line_components(occurrences).groupBy("root").count().collect())
        assert len(texts) > 250 and found == Counter({k: v for k, v in expected.items() if k > 1})


def test_bands_find_similar_pairs_of_any_length(spark):
    """Pairs at a similarity of 0.8 or a little more, by length: the share that has a band in common."""
    rng = random.Random(9)
    rows, wanted = [], Counter()
    for length in (14, 23, 50, 95, 365, 1000):
        for pair in range(1000 if length < 300 else 300):
            text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=length))
            changed = (length - lines.SIZE + 1) // 9
            other = text[:-changed] + "".join(rng.choices("0123456789", k=changed))
            x, y = (frozenset(t[i : i + lines.SIZE] for i in range(length - lines.SIZE + 1)) for t in (text, other))
            if 100 * len(x & y) >= lines.PERCENT * len(x | y):
                wanted[length] += 1
                rows += [(2 * len(rows), text, length, pair), (2 * len(rows) + 1, other, length, pair)]
    units = spark.createDataFrame(rows, "node long, norm string, length int, pair int")
    banded = lines.signatures(units.select("node", "norm", F.col("node").alias("at"))).select("node", F.explode("bands").alias("band"))
    met = units.join(banded, "node").groupBy("length", "pair", "band").agg(F.countDistinct("node").alias("n")).where("n = 2")
    found = Counter(r["length"] for r in met.select("length", "pair").distinct().collect())
    shares = {length: found[length] / n for length, n in wanted.items()}
    print(shares, dict(wanted))
    assert len(shares) == 6 and min(shares.values()) >= 0.965, shares


def test_shingles_of_a_long_line_do_not_copy_it_each(spark):
    text = prose(77, 60_000)
    wide = frame(spark, [(1, text), (2, "short"), (3, "")]).select("doc_id", F.encode("text", "UTF-16BE").alias("wide"))
    start = time.perf_counter()
    found = dict(wide.select("doc_id", F.size(lines._set(F.col("wide"), lines.SIZE))).collect())
    took = time.perf_counter() - start
    assert found == {1: len({text[i : i + lines.SIZE] for i in range(len(text) - lines.SIZE + 1)}), 2: 1, 3: 1}
    # Some 320,000 code units: copies of the whole line, one for each shingle, are some 200 GB.
    assert took < 10


def _generated(spark, df) -> int:
    """Rows that the generators of a frame make when it runs."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        done = df.select("*")
        done.collect()
    finally:
        spark.conf.set(key, before)
    nodes, total = [done._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_shingles_meet_in_a_row_before_they_meet_in_a_line(spark):
    """Signatures and bitmaps, of lines that are short, long and not a multiple of a row, and how many rows they take."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in (1, 5, 6, 7, 13, 99, 255, 256, 400, 401, 1700, 2100)]
    texts += ["é" * 3000, "ab" * 150, "\U0001f600x" * 30]
    units = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, norm string").coalesce(1)
    wide = units.select("node", F.encode("norm", "UTF-16BE").alias("wide"))
    grams = [[c[i : i + 12] for i in range(0, max(1, len(c) - 10), 2)] for c in (t.encode("utf-16-be") for t in texts)]
    hashed = spark.createDataFrame([(i, bytearray(g)) for i, gs in enumerate(grams) for g in gs], "node long, g binary")
    hashes = [[] for _ in texts]
    for r in hashed.select("node", F.xxhash64("g").alias("h")).collect():
        hashes[r["node"]].append(r["h"])
    levels = [(i, share) for i, t in enumerate(texts) for a, b, share in lines.LEVELS if a <= len(t.encode("utf-16-be")) // 2 <= b]
    minima = []
    for i, share in levels:
        sample = [(h % 2**64) >> 33 for h in hashes[i] if h % 2**share == 0]
        if sample:
            least = [min(((h ^ a) * f) % 2**31 for h in sample) for a, f in lines._ORDERS]
            minima.append((i, share, least))
    bands = [
        F.xxhash64(F.lit(b), "share", *[F.col("least")[b * lines.ROWS + r] for r in range(lines.ROWS)]) for b in range(lines.BANDS)
    ]
    expected = spark.createDataFrame(minima, "node long, share int, least array<int>").select("node", F.array(*bands).alias("bands"))
    signed = lines.signatures(units.withColumn("at", F.col("node")))
    assert Counter((r["node"], *r["bands"]) for r in signed.collect()) == Counter((r["node"], *r["bands"]) for r in expected.collect())
    maps = lines._bitmaps(wide, lines.SIZE)
    for r in maps.collect():
        held, words = {h % 2**64 for h in hashes[r["node"]]}, [0] * lines.WORDS
        for h in held:
            words[(h >> 6) % lines.WORDS] ^= 1 << (h & 63)
        assert r["n"] == len(held) and [r[f"b{i}"] % 2**64 for i in range(lines.WORDS)] == words
    n = sum(len(hashes[i]) for i, _ in levels)
    assert _generated(spark, signed) < 0.3 * n + len(lines.LEVELS) * len(texts) + len(levels)
    assert _generated(spark, maps) < 0.2 * sum(len(set(h)) for h in hashes) + len(texts)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_lines_go_and_columns_stay(spark):
    rows = [(1, "Keep this line.\nother words here"), (2, "keep this line. \n\nsecond"), (3, None), (4, ""), (5, "second")]
    docs = frame(spark, rows).coalesce(1)
    found = lines.without_fuzzy_lines(docs)
    assert found.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {
        1: "Keep this line.\nother words here",
        2: "\nsecond",
        3: None,
        4: "",
        5: "",
    }
    assert lines.fuzzy_lines(frame(spark, [])).count() == 0


# ---- 8: mixing --------------------------------------------------------------------------------


def test_targets_fill_up_and_share_again(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 7), ("", 90)], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    sizes = {"": 90, "a": 10, "b": 1000, "c": 500, None: 7}
    weights = dict(zip(sizes, [5, 2, 1, 5, 2], strict=True))
    targets, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * share >= 3 * sizes[s]}
        if not full:
            break
        for s in full:
            targets[s] = 3.0 * sizes[s]
            left -= targets[s]
        free -= full
    targets.update({s: weights[s] * share for s in free})
    assert found == pytest.approx(targets)


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = [(i, prose(i, 5 + i * 7 % 90), "x", "abc"[i % 3] if i % 11 else None, 0) for i in range(900)]
    docs = frame(spark, rows + odd_rows())
    found = mixing.mix_sources(docs, block_rows=50).collect()
    again = mixing.mix_sources(docs.repartition(7), block_rows=50).where("doc_id is not null").collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(key(r) for r in found if r["doc_id"] is not None) == sorted(map(key, again))
    taken, target = Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(WORD.findall(dict((x[0], x[1]) for x in rows).get(r["doc_id"]) or "")) or r["doc_id"] not in range(900)
    for s in "abc":
        assert abs(taken[s] - target[s]) <= 100
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(frame(spark, [(1, None), (2, "")])).collect()} == {0}


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(1)
    sizes, chances = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37)
    out = mixing.flight(sizes, chances, rng, land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(chances.sum()) and out @ sizes == pytest.approx(chances @ sizes)
    landed = mixing.flight(sizes, chances, rng, land=True)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed.sum() - chances.sum()) <= 1
    means = np.mean([mixing.flight(sizes[:20], chances[:20], rng, True) for _ in range(600)], axis=0)
    assert abs(means - 0.37).max() < 0.1


# ---- 9: toxicity ------------------------------------------------------------------------------


def test_toxic_sentences_are_found(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 1
        parts = [prose(i * 10 + k, 8).replace(".", "") for k in range(4)]
        if bad:
            parts[i % 4] += " " + ["zorgle", "Zorglisch", "vexnat"][i % 3]
        rows.append((i, ". ".join(parts) + ".", "x", "s", 0))
        labels.append((i, int(bad)))
    docs = frame(spark, rows + odd_rows())
    scored = toxicity.score_toxicity(docs, _labelled(spark, [*labels, (None, 1)], "toxic")).collect()
    assert len(scored) == 410
    by_id = {r["doc_id"]: r for r in scored}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((by_id[i]["score"] >= 0.5) == bool(y) for i, y in held)
    for i, y in held:
        if y:
            span = rows[i][1].encode()[by_id[i]["worst_start"] : by_id[i]["worst_end"]].decode().lower()
            assert re.search("zorgl|vexnat", span) and "." not in span
    assert by_id[5002]["worst_start"] is None and 0 <= by_id[5002]["score"] < 0.5


def test_toxicity_without_labels_is_zero(spark):
    docs = frame(spark, [(1, "a b", "x", "s", 0), (2, None, "x", "s", 0)])
    assert {r["score"] for r in toxicity.score_toxicity(docs, _labelled(spark, [], "toxic")).collect()} == {0.0}
    assert toxicity.score_toxicity(frame(spark, []), _labelled(spark, [(1, 1)], "toxic")).count() == 0


# ---- 10: passages -----------------------------------------------------------------------------


def test_passages_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PIECE_BYTES", 500)
    shared = [prose(50 + i, 12) for i in range(3)]
    rows = [(i, "\n".join([prose(i, 10), shared[i % 3].upper() if i % 2 else "  " + shared[i % 3], "é é", prose(i, 10)])) for i in range(20)]
    rows = [(*r, "x", "s", 0) for r in rows] + odd_rows()
    seen, expected = {}, Counter()
    for doc in sorted(range(len(rows)), key=lambda d: (rows[d][0] is None, rows[d][0] or 0, d)):
        at = 0
        for number, line in enumerate((rows[doc][1] or "").split("\n")):
            words = WORD.findall(line.translate(FOLD))
            if len(words) >= passages.MIN_WORDS:
                key = tuple(words)
                if key in seen:
                    expected[(rows[doc][0], number, at, at + len(line), len(words), *seen[key])] += 1
                else:
                    seen[key] = (rows[doc][0], number)
            at += len(line) + 1
    docs = frame(spark, rows).coalesce(1)
    found = passages.repeated_passages(docs).drop("row").collect()
    assert Counter(tuple(r) for r in found) == expected
    left = passages.without_passages(docs)
    texts = [x for r in left.collect() for x in (r["text"] or "").split("\n")]
    counts = Counter(k for x in texts if len(k := tuple(WORD.findall(x.translate(FOLD)))) >= passages.MIN_WORDS)
    assert max(counts.values()) == 1
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_runs_of_short_lines_are_passages(spark):
    """A passage broken into lines of up to seven words goes like one that is a single line."""
    words = prose(77, 60).split(" ")
    broken = "\n".join(" ".join(words[i : i + 6]) for i in range(0, 60, 6))
    alone = "one two three"
    texts = [f"{prose(1, 9)}\n{broken}\n\n{alone}", f"Own start.\n\n{broken.upper()}\n{prose(2, 9)}\n{alone}\n", "\n", None, alone, " ".join(words)]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    assert passages.repeated_passages(docs).count() == 0
    found = passages.repeated_passages(docs, paragraphs=True).collect()
    assert sorted((r["doc_id"], r["line"], r["n_words"], r["kept_doc_id"], r["kept_line"]) for r in found) == [
        (1, 2, 60, 0, 1),
        (1, 13, 3, 0, 12),
        (4, 0, 3, 0, 12),
        (5, 0, 60, 0, 1),
    ]
    left = {r["doc_id"]: r["text"] for r in passages.without_passages(docs, paragraphs=True).collect()}
    assert left == {0: texts[0], 1: f"Own start.\n\n{prose(2, 9)}\n", 2: "\n", 3: None, 4: "", 5: ""}
    assert passages.repeated_passages(frame(spark, []), paragraphs=True).count() == 0
