"""Learned and drawn results against plain Python, the laws they follow, and held-out rows."""

import collections
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import langid, mixing, quality, queries, sharding


def spark_hash(*values):
    """xxhash64 of int and long (and string) values as Spark chains it; ints are (value,) tuples."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def auc(pairs):
    pairs = sorted(pairs)
    ranks = {}
    for k, (s, _) in enumerate(pairs):
        ranks.setdefault(s, []).append(k + 1)
    good = [np.mean(ranks[s]) for s, y in pairs if y]
    n, m = len(good), len(pairs) - len(good)
    return (sum(good) - n * (n + 1) / 2) / (n * m)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in queries.op4_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null").collect()
    held = [(scores[r.doc_id].score, r.quality) for r in labels if r.doc_id in scores and scores[r.doc_id].held_out]
    assert len(held) > 40 and 0 < sum(y for _, y in held) < len(held)
    assert auc(held) > 0.9
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.8


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").where("lang is not null and text rlike '[a-z]'").collect()}
    held = [(langs[r.doc_id], r.lang_pred) for r in queries.op6_language(spark, d).collect() if r.held_out and r.doc_id in langs]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97


def test_follow_the_leader_is_the_plain_rule(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 12, 5)), None, int(rng.integers(0, 2))) for _ in range(30)]
    rows = [(c, rng.random(len(c)), y) for c, _, y in rows]
    got = quality.follow_leader(rows, passes=3)
    size = 1 << quality.HASH_BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for cells, values, y in rows:
            x = {int(c): float(v) for c, v in zip(cells, values)} | {size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z}
    assert got[size] == pytest.approx(want[size]) and all(got[i] == pytest.approx(v, abs=1e-12) for i, v in want.items())


def test_bayes_is_the_plain_rule(spark):
    known = [("en", "the cat sat"), ("en", "a dog ran"), ("fr", "le chat"), ("fr", "un été")]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(known)], "doc_id long, text string, lang string")
    test = [(9, "the chat"), (10, "été"), (11, "½ ② ³ 12"), (12, "12 !"), (13, "\U00010400"), (14, "zz")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(test, "doc_id long, text string"), langid.train(df)).collect()}
    cells = lambda t: [int(c) for part in langid._cells([t])[0] for c in part]
    counts = {k: collections.Counter(c for lang, t in known if lang == k for c in cells(t)) for k in ("en", "fr")}
    size = 1 << langid.HASH_BITS
    for i, t in test:
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {k: sum(math.log((c[x] + langid.ALPHA) / (sum(c.values()) + langid.ALPHA * size)) for x in cells(t)) for k, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-4)


def test_shards_and_slots_by_hand(spark):
    rows = [(i, None if i % 7 == 0 else f"text {i % 50}" * (i % 4)) for i in range(3000)]
    seed, shards = 20, 40
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    blocks = collections.defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        key = (i, zlib.crc32(raw), len(raw) + 16)
        h = [spark_hash((seed + k,), *key) for k in (0, 1, 2)]
        blocks[h[0] % max(1, min(sharding.MAX_BLOCKS, -(-len(rows) // sharding.ROWS_OF_BLOCK)))].append((h[1], i, h[2]))
    names = sorted(blocks)
    matrix = sharding.communication_matrix([len(blocks[b]) for b in names], shards, seed)
    held = collections.defaultdict(list)
    for b, sent in zip(names, matrix):
        order = iter(sorted(blocks[b]))
        for s, n in enumerate(sent):
            held[s] += [(h2 % sharding.PARTS, h2, i) for _, i, h2 in (next(order) for _ in range(n))]
    want = {i: (s, k) for s, v in held.items() for k, (_, _, i) in enumerate(sorted(v))}
    assert got == want


def test_draws_beyond_a_billion_follow_the_law():
    rng = np.random.default_rng(3)
    good, bad, n = 30_000_000, 970_000_000, 400  # as numpy draws just below its limit
    want = rng.hypergeometric(good - 300_000, bad - 9_700_001, n, 20_000)
    got = np.array([sharding._inverse(good, bad, n, rng.random()) for _ in range(20_000)])
    assert abs(got.mean() - want.mean()) < 0.12 and abs(got.var() / want.var() - 1) < 0.06
    assert [sharding._inverse(5, 3, 8, u) for u in (0.0, 0.5, 0.999999)] == [5, 5, 5]
    small = collections.Counter(sharding._inverse(3, 2, 2, (k + 0.5) / 1000) for k in range(1000))
    assert small == {0: 100, 1: 600, 2: 300}


def test_the_tree_places_the_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 90 + 10), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(docs, n_shards=4).collect()
    # by hand: every document's place in its source's stream, the blocks and where the tree sends them
    n_parts = max(1, -(-900 // mixing.ROWS_OF_PART))
    sizes = collections.Counter()
    streams = collections.defaultdict(list)
    for i in range(900):
        sizes["abc"[i % 3]] += i % 90 + 10
        h = spark_hash((7,), i, i % 90 + 10)
        streams["abc"[i % 3]].append((h % n_parts, h, i, i % 90 + 10))
    aim = mixing.targets(dict(sizes))
    rng = np.random.default_rng(7)
    words = [min(int(aim[s] + 0.5), 2 * sizes[s]) for s in "abc"]
    block = [max(mixing.BLOCK_WORDS, -(-w // mixing.MAX_BLOCKS)) for w in words]
    tree = mixing.splitting_tree(np.array([-(-w // b) for w, b in zip(words, block)]), 4, rng)
    want = collections.defaultdict(int)
    for k, s in enumerate("abc"):
        home = np.empty(tree[:, k].sum(), np.int64)
        home[rng.permutation(len(home))] = np.repeat(np.arange(4), tree[:, k])
        for epoch in range(3):
            at = epoch * sizes[s]
            for _, _, i, n in sorted(streams[s]):
                for w in range(at, min(at + n, words[k])):
                    want[i, epoch, w // block[k], int(home[w // block[k]])] += 1
                at += n
    assert {(r.doc_id, p.epoch, p.block, p.shard): p.n_words for r in got for p in r.pieces} == dict(want)
    # another tree, other places
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, n, rng: np.array([quotas] + [quotas * 0] * (n - 1)))
    assert {p.shard for r in mixing.mix(docs, n_shards=4).collect() for p in r.pieces} == {0}


def test_tree_follows_the_hypergeometric_law():
    quotas, draws = np.array([30, 60, 10]), 4000
    rng = np.random.default_rng(0)
    first = np.array([mixing.splitting_tree(quotas, 4, rng)[0] for _ in range(draws)])
    n, total = 25, 100
    share = quotas / total
    assert (first.sum(axis=1) == n).all() and np.allclose(first.mean(axis=0), n * share, atol=0.15)
    assert np.allclose(first.var(axis=0), n * share * (1 - share) * (total - n) / (total - 1), rtol=0.12)


def test_mixed_rows_stand_shard_by_shard(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    pieces = {(r.doc_id, p.epoch): (p.shard, p.place) for r in mixing.mix(docs, n_shards=4).collect() for p in r.pieces if p.from_word == 0}
    rows = mixing.mixed_documents(docs, n_shards=4).withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in pieces)
    places = collections.defaultdict(list)
    for i, e in pieces:
        places[i].append(pieces[i, e])
    by_part = collections.defaultdict(list)
    for r in rows:
        by_part[r.part].append(r.doc_id)
    for ids in by_part.values():  # inside a part some choice of each row's pieces is in order
        at = (-1, -(1 << 63))
        for i in ids:
            at = min(p for p in places[i] if p > at)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, lang_pred string, rep int"
    good = [(i, f"the quick brown fox number {i} jumps over the lazy dog of the house {i * 7} and then runs away", "en", "s", 1, 2, "x", "y", 3) for i in range(30)]
    odd = [(100, None, "en", "s", None, None, None, None, None), (101, "", None, None, None, None, None, None, None), (None, good[0][1] + " once more", "en", None, None, None, None, None, None), good[3], (102, "12 34", "en", "s", None, None, None, None, None)]
    for name, rows in (("some", good + odd), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "no such words as these"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in out} == {*range(30), None} and collections.Counter(r.doc_id for r in out)[3] <= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
