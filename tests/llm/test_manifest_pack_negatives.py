"""Merkle manifests, packing and hard negatives against plain Python, with odd rows and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bestfit, hardneg, merkle
from quillspark.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, lo int, path string, piece string, grp string, number int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """All levels of a tree over digests, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    """(left, right) of leaf i at each level."""
    out = []
    for level in tree[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]

    def leaf(r, text):
        return sha("".join(said(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + said(text))

    groups = {}
    for r in rows:
        low = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf(r, r["text"]), leaf(r, low if hit else r["text"])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]])
    crown = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (doc, own, start) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(crown, k)
            for left, right in path:
                start = sha("".join([*left, start, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((doc, own, trees[g][-1][0], crown[-1][0], proof, start, start == crown[-1][0]))
    return out


def odd_docs():
    r = random.Random(3)
    out = [(i, f"Text {i % 37} of A {r.random()}", r.choice(["en", "fr", "de", "é", "Z"]), r.choice(["a", None]), i) for i in range(700)]
    out += [(9000 + i, t, None, None, None) for i, t in enumerate([None, "", "ÀB \U0001f600 É", "x" * 2_000_000 + "A"])]
    out += [(None, "No id A", "en", "a", 1), (5, "Other text of 5", "en", None, None), (-12, "NEGATIVE", "lone", "b", 2)]
    return out + out[:3] + [out[3]] * 40


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "p", "q", "g", 2) for r in rows], DOCS).repartition(5)
    got = merkle.manifest(df, tampered={"text": merkle.lower_cased(F.col("doc_id"), F.col("text"))})
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_equals_plain_python(spark):
    got = manifest_of(spark, odd_docs())
    assert got == sorted(plain_manifest(odd_docs()), key=repr)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert manifest_of(spark, rows) == sorted(plain_manifest(rows), key=repr)


def test_a_proof_holds_for_its_own_row_only(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "fr", "s", i) for i in range(100)]
    df = spark.createDataFrame([(*r, "x", 1, "p", "q", "g", 2) for r in rows], DOCS)
    got = merkle.manifest(df).orderBy("doc_id").collect()
    assert all(x.verified for x in got) and len({x.root for x in got}) == 1
    moved = spark.createDataFrame([(a.leaf, b.path, a.root) for a, b in zip(got, got[1:])], "leaf string, path array<struct<left:binary,right:binary>>, root string")
    assert moved.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 0


TEXTS = [
    "", " ", "One two", "the QUICK brown's don't we'll 'll 'S it's", "<|endoftext|> a <|startoftext|>b x<|endoftext|>", "a\x1cb \x1dc\x1e d", "ΣΑΣ Σ ΟΔΟΣ", "İstanbul DŽ ǅ",
    "été ́x ñ", "tab\tnew\nline\r wide　x\xa0y z\x85w", "12345 x1y2 3.14% (paren) [a]-b ...!!", "\U0001f600\U0001f600 ok \U0001f468‍\U0001f469", "क़ड़ ช่วย 漢字かな",
    "Å Ω ﬁn ﬀ", "l'été qu'il", "''' '' ' \"'s\"", "a" * 5000, "﻿bom ​zero‍width", "q" * 100 + "'" * 100,
]


def test_ids_of_words_are_the_ids_of_texts():
    r, whole = random.Random(1), Tokenizer.from_file(PATH)
    words = WordIds(open(PATH, encoding="utf-8").read())
    assert words.local and words.lower
    pool = [w for t in TEXTS for w in t.split(" ")] + list("'.,<|>sStTré\x1c\x1f\x85\xa0́᠎")
    mixed = ["".join(r.choice(pool) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(300)]
    for text in TEXTS + mixed:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(words.encoded(text)), "<u4").tolist() == want, ascii(text)


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, whole = WordIds(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not words.local
    for text in TEXTS:
        assert np.frombuffer(b"".join(words.encoded(text)), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def pack_rows(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 7, None) for i, t in rows], "doc_id long, text string, piece string, sequence_id int, ids string").repartition(3)
    return bestfit.pack_documents(df, PATH, **kw)


def test_packing_gives_every_id_once_and_no_gap(spark):
    r = random.Random(8)
    texts = [*TEXTS, None, *(" ".join(r.choice(["alpha", "Beta,", "é", "x9"]) for _ in range(r.choice([1, 5, 300, 2047, 2048, 4095]))) for _ in range(60))]
    texts.append(" ".join(f"word{i % 997} q{i % 13}" for i in range(120_000)))  # over a million characters
    rows = [*enumerate(texts), (3, "One two"), (3, "One two"), (None, "no id")]
    got = pack_rows(spark, rows, keep_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(repr((i, whole.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows if i not in (3, None))
    docs = {}
    for p in got:
        docs.setdefault(p.doc_id, []).append(p)
    for i, ps in docs.items():
        if i in (3, None):
            continue
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and all(p.length == 2048 for p in ps[:-1]) and [p.start for p in ps] == [2048 * k for k in range(len(ps))]
    assert sorted(repr((i, [x for p in ps for x in p.ids])) for i, ps in docs.items() if i not in (3, None)) == want
    assert sum(p.doc_id == 3 for p in got) == 3 and sum(p.doc_id is None for p in got) == 1
    for p in got:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids)
    seqs = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(p.length for p in got) // 2048) + 1


def test_sequences_hold_their_pieces_in_order(spark):
    packed = pack_rows(spark, [(i, "alpha beta gamma " * (i % 9)) for i in range(40)], capacity=64, keep_ids=True)
    rows = packed.collect()
    for s in bestfit.sequences(packed).collect():
        mine = sorted((p.offset, p.doc_id, p.ids) for p in rows if p.sequence_id == s.sequence_id)
        assert s.ids == [x for _, _, ids in mine for x in ids] and s.doc_ids == [d for _, d, _ in mine] and len(s.ids) <= 64


def test_packing_of_an_empty_table(spark):
    assert pack_rows(spark, [(1, "a")]).where("doc_id = 2").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    got = bestfit.pack_documents(empty, PATH)
    assert got.count() == 0 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_each_piece_goes_where_the_squares_grow_least():
    r = random.Random(4)
    for _ in range(30):
        capacity = r.choice([10, 50])
        lengths = np.array([r.randint(1, capacity) for _ in range(200)])
        where, place = bestfit.sum_of_squares(lengths, capacity)
        gaps = {}
        for k in np.argsort(-lengths, kind="stable").tolist():
            s = int(lengths[k])

            def squares(moved):
                counts = {}
                for b, g in gaps.items():
                    g = g - s if b == moved else g
                    if g:
                        counts[g] = counts.get(g, 0) + 1
                return sum(c * c for c in counts.values())

            fits = [b for b, g in gaps.items() if g >= s]
            b = int(where[k])
            assert (b in gaps) == bool(fits)
            if fits:
                assert squares(b) == min(map(squares, fits))
            assert place[k] == capacity - gaps.get(b, capacity)
            gaps[b] = gaps.get(b, capacity) - s
            assert gaps[b] >= 0


def test_parts_pack_apart(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 50 + 1).alias("length"))
    got = bestfit.pack(rows, capacity=100, part=200).collect()
    used = {}
    for p in got:
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    assert len(got) == 3000 and max(used.values()) <= 100 and len(used) <= sum(used.values()) / 100 + 2 * 15


def plain_negatives(rows):
    keep = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, lab, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, lab, v in keep]

    def score(a, b):
        return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))

    out = set()
    for i, lab, v in whole:
        if i % 50:
            continue
        scored = [(-score(v, w), j, m) for j, m, w in whole]
        pos = sorted({(s, j) for s, j, m in scored if m == lab and j != i})[:5]
        for s, j in pos:
            neg = sorted({(t, n) for t, n, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s})[:3]
            out |= {(i, j, k + 1, n, -s, -t) for k, (t, n) in enumerate(neg)}
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, lab, v in rows], "vec_id long, embedding array<double>, label int, key string, v int, rank int").repartition(4)
    got = hardneg.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_negatives_equal_plain_python(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 20))
    rows = [(i, int(i % 6), (centres[i % 3] + r.normal(size=20) * 0.4).tolist()) for i in range(900)]
    rows += [(None, 1, [1.0]), (901, None, [1.0]), (902, 1, None), (903, 1, [1.0, None]), (904, 1, [float("nan")]), (950, 2, [float("inf")] * 20), (1000, 3, []), (1050, 3, [0.5, -0.5])]
    rows += [rows[7]] * 3 + [(7, 1, rows[8][2]), (50, 4, rows[9][2]), (50, 4, rows[9][2])]  # repeated rows, ids with several rows
    rows += [(2000 + k, k % 2, [0.5] * 20) for k in range(40)]  # ties
    want = plain_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 100


def test_negatives_of_vectors_beyond_whole_doubles(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 2, (r.normal(size=4) * 10.0 ** r.integers(0, 40)).tolist()) for i in range(120)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_an_empty_table_and_of_one_row(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_intervals_hold_the_score_and_rule_rows_out():
    r = np.random.default_rng(5)
    m = np.floor(r.normal(size=(2000, 64)) * 32)
    turned = hardneg.rotated(m)
    assert np.array_equal(turned[:9] @ turned[:9].T, 64 * (m[:9] @ m[:9].T))
    codes, aligned, squares = hardneg.coded(turned)
    row = {"ids": np.arange(2000).tobytes(), "labels": np.zeros(2000, np.int64).tobytes(), "whole": m.tobytes(), "codes": codes.tobytes(), "aligned": aligned.tobytes(), "squares": squares.tobytes()}
    block = hardneg.Block(row, 64, hardneg.LEVELS)
    for k in range(5):
        true, seen = m @ m[k], []

        def keep(low, high, live=np.arange(2000)):
            assert np.all(low <= true[live]) and np.all(true[live] <= high)
            seen.append((high - low).mean())
            return np.ones(len(low), bool)

        block.narrowed(hardneg.Anchor(turned[k]), np.arange(2000), keep)
        assert len(seen) > 1 and all(b < 0.9 * a for a, b in zip(seen, seen[1:]))  # each code narrows
        left = block.narrowed(hardneg.Anchor(turned[k]), np.arange(2000), lambda low, high: high >= np.sort(low)[-5])
        assert len(left) < 1000 and set(np.argsort(-true)[:5]) <= set(left)
