"""Whitening, the Merkle manifest, token counts and passage units against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import merkle, passages, quality, tokens, vectors, vocabulary, whitening
from plumbline.llm.vocabulary import Encoder
from tests.llm.fixtures import FOLD, WORD, frame, odd_rows, prose

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ---- 11: whitening ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, whitened string, component int"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)


def _whitened(spark, rows):
    found = {}
    for r in whitening.whitened_components(_vectors(spark, rows)).collect():
        found.setdefault(r["vec_id"], []).append(r)
    return found


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 12))
    good = [(i, [float(x) for x in np.float32(base @ rng.normal(size=12))]) for i in range(90)]
    bad = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    rows = good + bad + [(None, [0.5] * 12), (7, good[7][1])]
    kept = [r for r in rows if r not in bad]
    x = np.floor(np.array([v for _, v in kept], dtype=np.float64) * 1024).astype(object)
    x = np.array([[int(c) + 100_000 for c in row] for row in x], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = ((n * x - sums) / n).astype(np.float64)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    expected = centred @ axes[:, :8] / np.sqrt(values[:8])
    found = _whitened(spark, rows)
    assert set(found) == {i for i, _ in kept}
    signs = None
    for at in (0, 1, 5, 89):
        mine = sorted(found[at], key=lambda r: r["component"])[:: 2 if at == 7 else 1]
        assert [r["component"] for r in mine] == list(range(1, 9))
        got = np.array([r["whitened"] for r in mine])
        signs = np.sign(got * expected[at]) if signs is None else signs
        assert np.allclose(got, signs * expected[at], atol=1e-9)
        assert {int(r["deviation"]) for r in mine} == {deviation[at]} and {r["n"] for r in mine} == {n}
        assert np.allclose([r["explained"] for r in mine], values[:8] / values.sum(), rtol=1e-9)
    assert len(found[7]) == 16 and len(found[None]) == 8
    assert found[0][0]["identity_error"] < 1e-9


def test_polarised_sums_are_exact_beyond_int64(spark):
    rows = [(i, [1e9 * ((i * 7) % 5 - 2), 3.25 * i, -1e9 + i]) for i in range(40)]
    kept = whitening._kept(_vectors(spark, rows), "vec_id", "embedding")
    model = whitening.fit(kept)
    x = [[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    away = [[40 * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    assert model.sums == sums
    for i in range(3):
        for j in range(i, 3):
            exact = sum((a[i] + (a[j] if i != j else 0)) ** 2 for a in away)
            assert model.squares[i, j] == exact


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert _whitened(spark, []) == {}
    assert _whitened(spark, [(1, None)]) == {}
    assert _whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == {}
    one = _whitened(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])
    assert [len(v) for v in one.values()] == [1, 1]
    assert np.allclose([abs(v[0]["whitened"]) for v in one.values()], 1)
    with pytest.raises(Exception, match="length"):
        whitening.fit(whitening._kept(_vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "vec_id", "embedding"))


# ---- 12: manifest -----------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(digests):
    """The root and, for each leaf, the (before, after) siblings level by level."""
    proofs, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, place in enumerate(places):
            first = place // 16 * 16
            proofs[leaf].append(("".join(digests[first:place]), "".join(digests[place + 1 : first + 16])))
            places[leaf] = place // 16
        digests = [_h(*digests[i : i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], proofs


def _manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    names = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == n), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1]))) for n in names]
    trees = [_tree([_leaf(r, r[1]) for r in g]) for g in groups]
    root, tops = _tree([t[0] for t in trees])
    found = Counter()
    for group, (subroot, proofs), top in zip(groups, trees, tops, strict=True):
        for row, proof in zip(group, proofs, strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = _leaf(row, row[1].translate(FOLD) if hit and row[1] else row[1])
            for before, after in proof + top:
                folded = _h(before, folded, after)
            hashed = _h(*[x for pair in proof + top for x in pair])
            found[(row[0], _leaf(row, row[1]), subroot, root, hashed, folded, folded == root)] += 1
    return found


def _climbed(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    altered = [*(F.col(f) for f in merkle.FIELDS if f != "text"), text]
    return merkle.climb(merkle.build(docs, altered=altered))


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest_equals_plain_hashing(spark, sources):
    rows = [(i * 3 % 701, f"Text {i} É" if i % 4 else "no capitals", "x", f"s{(i * i) % sources}" if i % 2 else "s0", i) for i in range(340)]
    rows += [(9001 + i, "Lone", None, f"alone{i}é", 1) for i in range(2)] if sources > 1 else []
    rows += odd_rows() if sources == 40 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS tree", "'x' AS place", "3 AS leaf", "4 AS level", "5 AS at", "6 AS width"
    )
    found = Counter(tuple(r) for r in _climbed(docs.repartition(5)).collect())
    assert found == _manifest(rows)
    assert {k[-1] for k in found} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = frame(spark, [(2, "Alone", "x", "s", 5)])
    assert Counter(tuple(r) for r in _climbed(one).collect()) == _manifest([(2, "Alone", "x", "s", 5)])
    assert _climbed(frame(spark, [])).count() == 0


# ---- 13: token counts -------------------------------------------------------------------------


def _hard_texts():
    rng = random.Random(5)
    mixed = "".join(rng.choice(["don't ", "we'll", "  ", "\n\n", "é", "12", "...", " 'tis", "<|endoftext|>", "x" * 9, " ", "日本", "🙂"]) for _ in range(3000))
    return [
        mixed,
        "a" * 9000,
        " " * 5000 + "b" + "\n" * 4000,
        "'ll" * 3000,
        "<|endoftext|>" * 700,
        "é" * 6000 + " ok",
        "🙂" * 2000,
        "1" * 4000 + "a" * 4000 + "." * 4000,
        prose(3, 3000),
        " " * 3000 + "　x" * 900,
        "<|endof" + "text|>" * 900,
    ]


def test_token_counts_equal_whole_encodings(spark):
    whole = Tokenizer.from_file(TOKENIZER)
    texts = [*_hard_texts(), "", "short one", "x" * 64, "x" * 65, "Hi<|endoftext|> there"]
    rows = [(i, t, "x", "s", 0) for i, t in enumerate(texts)] + odd_rows()
    docs = frame(spark, rows).selectExpr("*", "1 AS row", "'y' AS t", "2 AS n_tokens", "3 AS k")
    for chunk, overlap in ((64, 16), (100, 50), (1000, 40), (32_768, 1024)):
        found = tokens.count_tokens(docs, TOKENIZER, chunk, overlap).collect()
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found)
        assert got == Counter(
            (r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False))) for r in rows
        )
        assert chunk > 64 or max(r["n_chunks"] for r in found) > 50
    assert tokens.count_tokens(frame(spark, []), TOKENIZER).count() == 0


def test_token_counts_refuse_what_is_not_proven(spark):
    with pytest.raises(ValueError, match="byte-level"):
        tokens.count_tokens(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="overlap"):
        tokens.count_tokens(frame(spark, []), TOKENIZER, chunk=10, overlap=6)


# ---- ids ---------------------------------------------------------------------------------------


def _packed(tool, text):
    return np.array(tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_those_of_tokenizers():
    whole, tool, rng = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER), random.Random(8)
    assert tool.merging is not None and tool.byte_level
    parts = ["<|endoftext|>", " ", "a", " b,", ".", "\n", "<|", "é.", " foo", "|>", "\x1c", "\xa0", "\u0085", "x,", "'ll", "\u200b", "\u180e", "日", "🙂", "\0", "\t"]
    latin = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xA1, 0x250)), *"\t\n\x0b\x0c\r   "]
    texts = ["foo <|endoftext|> bar", "", "a" * 5000, " " * 3000 + "x", "é" * 999 + " " + "b" * 1000]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500)]
    texts += ["".join(rng.choices(latin, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += [prose(i, 200, "abcdeé,.'T") for i in range(50)]
    assert tool.packed(texts) == [_packed(whole, t) for t in texts]
    assert sum(map(tool._is_plain, texts)) > 3000
    assert np.frombuffer(tool.packed(["foo <|endoftext|> bar"])[0], "<u4").tolist() == [21943, 220, 50256, 2318]


def test_every_token_encodes_to_itself():
    """What the lowest-id merges rest on, see plumbline.llm.vocabulary."""
    tool = Encoder(TOKENIZER)
    letters = {b: c for c, b in vocabulary._byte_letters().items()}
    bare = Tokenizer(tool.whole.model)
    tokens = [t for t in tool.settings["model"]["vocab"] if t not in tool.special]
    assert len(letters) == 256 and len(tokens) == 50_256
    assert all(len(e.ids) == 1 for e in bare.encode_batch_fast(tokens, add_special_tokens=False))


def test_other_files_are_left_to_tokenizers():
    tool = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not tool.byte_level and tool.merging is None
    assert tool.packed(["Some words."]) == [_packed(Tokenizer.from_file(tool.path), "Some words.")]


# ---- 10: passages -----------------------------------------------------------------------------


def _units(rows, passage):
    """Counter of (doc_id, line, n_lines, start, end, n_words, kept, kept_doc_id, kept_line)."""
    units = []
    for d, row in enumerate(rows):
        at, unit, block, open_block = 0, 0, -1, False
        for number, line in enumerate((row[1] or "").split("\n")):
            words = tuple(WORD.findall(line.translate(FOLD)))
            if words:
                block += not open_block
                units.append([d, number, 1, at, at + len(line), words, unit, block])
                unit += 1
            open_block = bool(words)
            at += len(line) + 1
    for d in range(len(rows)):
        for b in {u[7] for u in units if u[0] == d}:
            inside = [u for u in units if u[0] == d and u[7] == b and u[2] == 1]
            if len(inside) > 1:
                words = sum((u[5] for u in inside), ())
                units.append([d, inside[0][1], len(inside), inside[0][3], inside[-1][4], words, inside[0][6], b])
    order = {d: p for p, d in enumerate(sorted(range(len(rows)), key=lambda d: (rows[d][0] is None, rows[d][0] or 0, d)))}
    units.sort(key=lambda u: (order[u[0]], u[3], u[2]))
    first = {}
    again = [first.setdefault(u[5], u) is not u for u in units]
    whole = {(u[0], u[7]) for u, r in zip(units, again, strict=True) if r and u[2] > 1 and len(u[5]) >= passage}
    runs: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        if u[2] == 1 and again[i]:
            runs.setdefault(u[0], []).append(i)
    gone = set()
    for places in runs.values():
        while places:
            run = [places.pop(0)]
            while places and units[places[0]][6] == units[run[-1]][6] + 1:
                run.append(places.pop(0))
            if sum(len(units[i][5]) for i in run) >= passage:
                gone.update(run)
    out = Counter()
    for i, u in enumerate(units):
        kept = i not in gone and (u[0], u[7]) not in whole
        f = first[u[5]]
        out[(rows[u[0]][0], *u[1:5], len(u[5]), kept, rows[f[0]][0], f[1])] += 1
    return out


@pytest.mark.parametrize("passage", [1, 20, 50])
def test_passage_units_equal_plain_python(spark, passage):
    rng = random.Random(passage)
    pool = [prose(60 + i, n) for i, n in enumerate([3, 5, 9, 14, 30, 60])] + ["", " \t", "Ein Satz."]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else prose(1000 + 50 * i + k, rng.randint(1, 12)) for k in range(rng.randint(0, 9))]
        rows.append((i % 50, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines), "x", "s", 0))
    rows += odd_rows()
    docs = frame(spark, rows).selectExpr("*", "1 AS row", "2 AS unit", "3 AS `first`", "4 AS kept").coalesce(1)
    found = passages.passage_units(docs, passage).drop("row", "digest").collect()
    assert Counter(tuple(r) for r in found) == _units(rows, passage)
    assert passages.passage_units(frame(spark, []), passage).count() == 0


def test_planted_passages_go_whatever_surrounds_them(spark):
    """A passage of over 50 words goes as one line, in short lines, and with moved line breaks. A short common line
    stays unless it stands next to one."""
    words = prose(5, 60).split(" ")
    one, common = " ".join(words), "please do not copy this line"
    short = "\n".join(" ".join(words[i : i + 6]) for i in range(0, 60, 6))
    moved = "\n".join([" ".join(words[:25]), " ".join(words[25:])])
    own = [prose(200 + i, 20) for i in range(8)]
    texts = [
        f"{own[0]}\n{one}\n{common}\n{own[1]}",
        f"{common}\n{own[2]}\n{one.upper()}",
        f"{own[3]}\n{short}\n{common}",
        f"{own[4]}\n\n{moved}\n\n{own[5]}",
        f"{common}\n{short}\n{own[6]}",
        f"{own[7]}\n{common}",
    ]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    found = passages.passage_units(docs).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == {1, 3, 4}
    left = passages.without_repeats(passages.without_repeats(docs)).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {
        **{i: texts[i] for i in (0, 2, 5)},
        1: f"{common}\n{own[2]}",
        3: f"{own[4]}\n\n\n{own[5]}",
        4: own[6],
    }
    again = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in passages.without_repeats(docs).collect()}
    start = texts[1].index(one.upper())
    assert again[1] == [(start, start + len(one))] and again[0] == []


# ---- 2 and 6: what had no plain version ---------------------------------------------------------


def _plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    folded = [w.translate(FOLD) for w in words]
    count, characters = max(1, len(words)), max(1, sum(map(len, words)))
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    octets = text.encode()
    letters = [b for b in octets if chr(b).isascii() and chr(b).isalpha()]
    capitals = [b for b in letters if chr(b).isupper()]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    plain = set(range(128, 256)) | {ord(c) for c in " \t\n\r.,;:'-0123456789"} | set(range(65, 91)) | set(range(97, 123))
    logit = lambda share: math.log((s := min(max(share, 1e-3), 1 - 1e-3)) / (1 - s))
    return [
        math.log1p(len(words)),
        math.log(min(max(characters / count, 1), 30)),
        logit(symbols / (count + symbols)),
        logit(len(capitals) / max(1, len(letters))),
        logit(len(again) / count),
        logit(sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / count),
        logit(text.count("!") / (count + 1)),
        math.log(len(set(folded)) / math.sqrt(count) + 0.1),
        logit(sum(b not in plain for b in octets) / characters),
    ]


def test_quality_statistics_equal_plain_python(spark):
    texts = ["", None, "One", "SHOUT shout Shout! really!! $$$ <b>", "a b c a b c a b c", "é è ü. Ñandú, 12 {odd} @you", "x\n\n y\ty"]
    texts += [prose(i, 5 + 7 * i, "aeilmnorstu.!#AB{") for i in range(30)] + [r[1] for r in odd_rows()]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["x"] for r in quality.statistics(docs).collect()}
    for at, text in enumerate(texts):
        assert np.allclose(found[at], _plain_statistics(text), atol=1e-9), (at, found[at], _plain_statistics(text))


def test_near_vectors_take_labels_of_any_type_and_clashing_names(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.01 * rng.normal(size=8)], i % 2 if i % 7 else None) for i in range(60)]
    numbers = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    words = numbers.selectExpr("vec_id", "embedding", "concat('l', label) AS label", "1 AS row", "2 AS d1", "'x' AS usable", "3 AS unit")
    one, two = (sorted(map(tuple, vectors.near_vectors(f).collect())) for f in (numbers, words))
    assert one == two and len({r[2] for r in one}) < 60
