"""The similarity join against brute force where many documents share passages, and its filters."""

import random

import numpy as np
import pytest

from quillspark.llm import jaccard


def components(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    # documents that can link share one of their first tokens in any order: here sorted, with rare ones first
    df = {}
    for s in sets:
        for x in s:
            df[x] = df.get(x, 0) + 1
    held = {}
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (df[x], x))[: len(s) - (4 * len(s) + 4) // 5 + 1]:
            for j in held.setdefault(x, []):
                if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
            held[x].append(i)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("hot, part", [(4096, 2048), (8, 5)])
def test_many_documents_share_a_passage(spark, monkeypatch, hot, part):
    monkeypatch.setattr(jaccard, "HOT_COUNT", hot)
    monkeypatch.setattr(jaccard.common_tokens, "__defaults__", (part,))
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    texts = []
    for i in range(2000):
        if i % 50 == 7:  # a near copy of an earlier one
            words = texts[r.randrange(len(texts))].split()
            words[r.randrange(len(words))] = "new"
            texts.append(" ".join(words))
        elif i % 100 == 9:  # nearly nothing but the passage
            texts.append(passage + " " + r.choice(vocab))
        else:
            texts.append(passage + " " + " ".join(r.choice(vocab) for _ in range(r.randint(8, 40))))
    want, sizes = components(texts)
    got = {x.doc_id: x for x in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in range(2000)] == want and [got[i].n_shingles for i in range(2000)] == sizes
    assert 20 < sum(i != c for i, c in enumerate(want)) < 500


def test_orders_never_stop_a_link():
    rng = np.random.default_rng(1)
    stopped = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([1.0, 0.95, 0.9, 0.5])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 8))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        ok = all(jaccard.may_link(jaccard._prefix_random(a, s), jaccard._prefix_random(b, s), len(a), len(b)) for s in (jaccard.B_SEED, jaccard.C_SEED))
        stopped += not ok
        assert ok or 100 * both < 80 * (len(a) + len(b) - both)
    assert stopped > 500
