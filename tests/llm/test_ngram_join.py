"""The join against all pairs, where keys are shared by very many documents."""

import random

import numpy as np
import pytest

from churnlab.llm import ngram_join
from churnlab.llm.common import shingle_hashes, words_of


def brute(docs):
    """(n_shingles, component_id) by doc_id from all pairs, on the words themselves."""
    sets = {}
    for i, t in docs:
        w = [x.decode() for x in words_of(t)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Documents of few word runs in common order, so that most shingles are frequent, with near
    copies of all sizes just above and below the threshold."""
    rnd = random.Random(seed)
    runs = [" ".join(f"r{k}w{i}" for i in range(12)) for k in range(25)]
    docs = []
    for _ in range(150):
        own = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 30)))
        docs.append(" ".join([*rnd.sample(runs, rnd.randint(1, 8)), own]).strip())
    for _ in range(250):
        w = rnd.choice(docs).split()
        for _ in range(rnd.randint(0, max(1, len(w) // 12))):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        docs.append(" ".join(w[rnd.randint(0, 2) :]))
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 8)  # so that the small table has frequent tokens
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute(docs)


def test_folded_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)]))
        differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ngram_join.folded(a), ngram_join.folded(b)))
        assert differ <= len(np.setxor1d(a, b))
    assert ngram_join.folded(np.zeros(0, np.uint64)) == [0] * ngram_join.FOLDS
    assert len(shingle_hashes(words_of("a b c d e f"))) == 2
