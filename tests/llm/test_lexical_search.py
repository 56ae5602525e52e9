"""The dual-tree search against scoring all pairs, and edge rows."""

import math
import random
import re

import numpy as np
import pytest

from churnlab.llm import lexical_search as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text.translate(LOWER)) if text else []


def brute(docs, items, k):
    """Rows (item_id, rank, doc_id, score) from all pairs."""
    texts = [(i, words(t)) for i, t in docs]
    n, length = sum(1 for _, w in texts if w), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in sorted(set(items), key=repr):
        ranked = []
        for doc, w in texts:
            if not w:
                continue
            m = 100 - 50 + (50 * len(w) * n) // length
            score = 0
            for t in set(words(text)):
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc))
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(ranked[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, partitions=3, **kw):
    d = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(partitions)
    b = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    return sorted(map(tuple, ls.search(d, b, **kw).collect()), key=repr)


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 80)))) for i in range(n)]


@pytest.mark.parametrize("partitions, block", [(1, 10**6), (4, 10**6), (3, 150)])
def test_equals_all_pairs(spark, partitions, block):
    docs, items = corpus(500, 1), corpus(25, 2)
    assert found(spark, docs, items, partitions, k=7, block_chars=block, seed_docs=40) == brute(docs, items, 7)


def test_ties_copies_and_ids(spark):
    """Thousands of equal documents: of these the smallest ids, a null id last, repeated rows each."""
    docs = [(i, "alpha beta gamma") for i in range(2000, 1000, -1)] + [(5, "Alpha"), (5, "Alpha"), (6, "alpha x"), (None, "alpha beta gamma")] + corpus(200, 3)
    items = [(1, "ALPHA beta"), (1, "ALPHA beta"), (1, "gamma"), (2, "w5 w7"), (3, "alpha")]
    assert found(spark, docs, items, 5, k=20, seed_docs=10) == brute(docs, items, 20)
    few = [(None, "one"), (9, "one"), (8, "one")]
    assert [r[2] for r in found(spark, [*few, (1, "x")], [(1, "one")], k=5)] == [8, 9, None]


def test_terms_follow_the_pattern():
    for t in ["a_b C9-d\x7fE É é z\x00q ÀB ß 9z~", "İI ſ K  x", "", None, "日本 語Z\n\tq"]:
        assert [w.decode() for w in ls.terms_of(t)] == words(t)
    assert ls.terms_of("a\ud800b") == ["a\ud800b".encode("utf-8", "surrogatepass")]


def test_nulls_empties_and_long_texts(spark):
    long = " ".join(f"w{i % 50} u{i}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " -- "), (4, long), (5, "w1 w2"), (6, "w3")]
    items = [(1, None), (2, ""), (3, "w1 w3 u59999"), (None, "w2"), (4, "nowhere")]
    assert found(spark, docs, items) == brute(docs, [i for i in items if i[1]], 50)
    assert found(spark, [], items) == [] == found(spark, docs, []) == found(spark, [(1, None)], items)


def test_whole_branches_are_left_out():
    """Without changing a result: pairs scored are fewer than all pairs."""
    rng = np.random.default_rng(4)
    docs = []
    for i in range(4000):  # two vocabularies that hardly meet
        base = 0 if i % 2 else 500
        docs.append((i, np.unique(base + np.minimum(rng.zipf(1.3, 40) - 1, 499))))
    terms = [np.unique(500 * (j % 2) + np.minimum(rng.zipf(1.3, 15) - 1, 499)).astype(np.int64) for j in range(20)]
    df = np.bincount(np.concatenate([t for _, t in docs]), minlength=1000)
    weights = np.array([math.floor(1000 * math.log(8002 / (2 * x + 1))) for x in df], np.int64)
    search = ls.Search(terms, weights, ls.hierarchy(terms), 4000, 160_000, 10, np.zeros(20, np.int64))
    cut = np.concatenate([[0], np.cumsum([len(t) for _, t in docs])])
    flat = np.concatenate([t for _, t in docs]).astype(np.int64)
    ids = np.arange(4000)
    best = ls.Best(search)
    batch = ls.batch_of(search, best, ids, ids < 0, np.full(4000, 40), flat, np.ones(len(flat), np.int64), cut)
    batch.run()
    assert batch.scored < 0.5 * 4000 * 20
    value = 10**9 // (1000 + 20 * (50 + 50 * 40 * 4000 // 160_000))
    for i, t in enumerate(terms):
        score = np.array([weights[np.intersect1d(t, d)].sum() * value for _, d in docs])
        order = np.lexsort((ids, -score))[:10]
        assert best.held[i][1].tolist() == order.tolist() and best.held[i][0].tolist() == score[order].tolist()


def test_large_lengths_do_not_overflow():
    n = np.array([10**12, 5])
    got = ls.impacts(n, np.array([3, 2]), np.array([0, 1]), 10**10, 10**13)
    assert got.tolist() == [10**9 * tf // (1000 * tf + 20 * (50 + 50 * x * 10**10 // 10**13)) for x, tf in ((10**12, 3), (5, 2))]
