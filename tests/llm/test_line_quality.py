"""The field against enumeration of all states, the gradient, edge rows and held-out labels."""

import itertools
import zlib

import numpy as np
import pytest

from churnlab.llm import line_quality as lq
from churnlab.llm.common import table

CLEAN = "This is a line of plain words that says something or other.\nAnd one more line follows it, as plain as the first."
SHOUT = "BUY!! NOW!! THE!! BEST!! OF!! ALL!!\nONLY!! TODAY!! AND!! ONLY!! HERE!!"
SCHEMA = "doc_id long, text string, Score string, lines int, quality int, c0 int, r int"


def enumerated(odds, pair):
    """Marginals of state 1 and of neighbouring states by summing over all state sequences."""
    n = len(odds)
    one, two, z = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for s in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(o for o, k in zip(odds, s) if k) + sum(pair[a, b] for a, b in zip(s, s[1:])))
        z += w
        one += w * np.array(s)
        for t in range(1, n):
            two[t, s[t - 1], s[t]] += w
    return one / z, two / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [1, 6, 3, 3, 1, 8]
    doc = np.repeat(np.arange(6), lengths)
    odds, pair = rng.normal(0, 3, len(doc)), rng.normal(0, 2, (2, 2))
    got, joint = lq.forward_backward(odds, pair, doc)
    for d in range(6):
        one, two = enumerated(odds[doc == d], pair)
        assert np.allclose(lq.sigmoid(got[doc == d]), one)
        assert np.allclose(joint[doc == d], two)
    assert len(lq.forward_backward(np.zeros(0), pair, np.zeros(0, int))[0]) == 0


def test_fitted_transitions_follow_the_labels():
    """States that stick together beyond what the lines show raise the scores of staying."""
    rng = np.random.default_rng(2)
    texts, states = [], []
    for _ in range(200):
        s = int(rng.integers(2))
        lines, own = [], []
        for _ in range(12):
            s = 1 - s if rng.random() < 0.05 else s
            shown = s if rng.random() < 0.7 else 1 - s
            lines.append("LOUD WORDS!! HERE!!" if shown else "quiet words here.")
            own.append(s)
        texts.append("\n".join(lines))
        states += own
    lines = lq.lines_of(texts)
    model = lq.Model(np.zeros((3, len(lq.MEASURES), lq.CLASSES + 1)), 0.0, np.zeros((2, 2)), np.zeros(3), 0.5, 0.5)
    y = np.array(states)
    lq.fit_field(model, lines, y, 150)
    assert model.pair[0, 0] + model.pair[1, 1] - model.pair[0, 1] - model.pair[1, 0] > 1
    odds, joint = lq.forward_backward(model.odds(lines.features()), model.pair, lines.doc)
    assert ((odds > 0) == y).mean() > 0.82
    # at the optimum the expected transitions are those seen
    seen = np.mean(y[1:][lines.doc[1:] == lines.doc[:-1]] != y[:-1][lines.doc[1:] == lines.doc[:-1]])
    expected = (joint[:, 0, 1] + joint[:, 1, 0]).sum() / (lines.doc[1:] == lines.doc[:-1]).sum()
    assert abs(seen - expected) < 0.02


def test_lines_and_their_measures():
    lines = lq.lines_of(["AB cd!!\n \n\nx x x 1", None, "", "  \t", "é|É\n"])
    assert lines.doc.tolist() == [0, 0, 4] and lines.n_docs == 5
    assert list(zip(lines.begin.tolist(), lines.end.tolist())) == [(0, 7), (11, 18), (0, 3)]
    at = list(lq.MEASURES)
    raw = [[0.5, 2 / 6, 0, 1, 0, 0.5, 0, 3, 2], [0, 0, 0.25, 0.5, 0.5, 0, 1, 1, 4], [0.5, 1 / 3, 0, 1, 0, 0, 0, 3, 1]]
    for row, got in zip(raw, lines.classes.tolist()):
        assert got == [int(np.searchsorted(lq.MEASURES[m], v)) for m, v in zip(at, row)]
    f = lines.features()
    assert f[1, 1].tolist() == f[0, 0].tolist() and f[2, 0].tolist() == f[0, 1].tolist()
    assert (f[1, [0, 2]] == lq.CLASSES).all() and (f[2, [1, 2]] == lq.CLASSES).all()


def small(spark):
    texts = [CLEAN + f"\nLine {i} ends." for i in range(30)] + [SHOUT + f"\nLINE!! {i}!!" for i in range(30)]
    rows = [(i, t, "s", 1, int(i < 30), 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_edge_rows(spark):
    docs = small(spark)
    long = "\n".join([CLEAN] * 30_000)
    odd = [(100, None), (101, ""), (102, " \n\t"), (103, CLEAN), (103, CLEAN), (None, SHOUT), (104, long), (105, "x" * 300_000), (106, "\ud800".encode("utf-8", "replace").decode())]
    more = spark.createDataFrame([(i, t, "s", 1, None, 2, 3) for i, t in odd], SCHEMA)
    model = lq.train(docs, docs.select("doc_id", "quality"))
    out = lq.score(docs.unionByName(more), model, with_lines=True)
    assert sorted(out.columns) == sorted(["doc_id", "text", "quality", "c0", "r", "score", "n_lines", "bad_lines", "lines"])
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.c0 == 2 and r.r == 3 and r.n_lines == len(r.lines) and 0 <= r.score <= 1
    assert len({got[i][0].score for i in (100, 101, 102)}) == 1 and got[100][0].n_lines == 0
    assert len(got[103]) == 2 and got[103][0].score == got[103][1].score > 0.9
    assert got[None][0].score < 0.1 and got[None][0].bad_lines == 2
    assert got[104][0].n_lines == 60_000 and got[104][0].score > 0.9
    r = got[40][0]
    assert [r.text[x.begin : x.end] for x in r.lines] == r.text.split("\n") and all(x.good < 0.5 for x in r.lines)


def test_a_bad_line_among_good_ones(spark):
    docs = small(spark)
    model = lq.train(docs, docs.select("doc_id", "quality"))
    mixed = spark.createDataFrame([(1, CLEAN + "\n" + SHOUT + "\n" + CLEAN)], "doc_id long, text string")
    r = lq.score(mixed, model, with_lines=True).first()
    assert [x.good >= 0.5 for x in r.lines] == [True, True, False, False, True, True]


def test_labels_of_one_class_or_none(spark):
    docs = small(spark)
    good = lq.train(docs, docs.select("doc_id", "quality").filter("quality = 1"))
    assert {r.score for r in lq.score(docs, good).collect()} == {1.0}
    none = lq.train(docs, docs.select("doc_id", "quality").limit(0))
    assert {r.score for r in lq.score(docs, none).collect()} == {0.5}
    assert lq.score(docs.limit(0), good).collect() == []
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (40, 0)], "doc_id long, quality int")
    texts, y, share = lq.labelled_sample(docs, nulls, "quality", 10, 1000)
    assert y.tolist() == [0, 1] and share == 0.5 and texts[0].startswith("BUY!!")


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.97), ("sf0.1", 0.98)])
def test_held_out_labels(spark, sf, least):
    folder = f"/root/testdata/{sf}"
    out = lq.op13_line_quality(spark, folder)
    rows = out.join(table(spark, folder, "labels"), "doc_id").select("doc_id", "held_out", "predicted", "score", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) >= least
    assert out.count() == table(spark, folder, "documents").count()
