"""The words' field against enumeration, its fitted transitions, and the spans of the query."""

import itertools

import numpy as np
import pytest

from churnlab.llm import toxicity
from churnlab.llm.common import table


def test_marginals_and_transitions_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 3, 7, 1, 2])
    unary, pair = rng.normal(0, 3, lengths.sum()), rng.normal(0, 2, (2, 2))
    one, two, at = np.zeros(len(unary)), np.zeros((2, 2)), 0
    for n in lengths.tolist():
        u, z = unary[at : at + n], 0.0
        own, seen = np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(x for x, k in zip(u, s) if k) + sum(pair[a, b] for a, b in zip(s, s[1:])))
            z += w
            own += w * np.array(s)
            for a, b in zip(s, s[1:]):
                seen[a, b] += w
        one[at : at + n], two, at = own / z, two + seen / z, at + n
    chains = toxicity.Chains(lengths)
    passes = chains.passes(unary, pair)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    later = np.setdiff1d(np.arange(len(unary)), starts)
    assert np.allclose(toxicity.sigmoid(chains.marginals(unary, pair)), one)
    assert np.allclose(chains.transitions(unary, pair, passes, later), two)


@pytest.mark.parametrize("n", [16, 60, 600])
def test_marks_by_one_rule_at_every_size(n):
    """A word of every toxic document is a mark, words of both kinds and rare chance words aren't."""
    rng = np.random.default_rng(n)
    toxic = np.arange(2 * n) % 2
    common = [f"{chr(97 + i)}plain" for i in range(20)]
    rare = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in toxic]
    texts = [" ".join([*rng.choice(common, 8), r, *(["vilest"] if y else [])]) for r, y in zip(rare, toxic)]
    labels, _ = toxicity.token_labels([toxicity.sentences(t) for t in texts], toxic)
    words = [w for t in texts for s in toxicity.sentences(t) for w in s]
    assert {w for w, y in zip(words, labels) if y} == {"vilest"}


def test_query_returns_offsets_of_the_marginals(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(rows) == len(docs)
    with_spans = [r for r in rows.values() if r.spans]
    assert with_spans
    for r in with_spans:
        ends = 0
        for x in r.spans:
            part = docs[r.doc_id][x.begin : x.end]
            assert ends <= x.begin < x.end <= len(docs[r.doc_id]) and x.probability >= 0.5
            assert part == part.strip() and not set(part) & set(".!?\n")
            ends = x.end
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id in labels]
    assert all(r.predicted for r in held if labels[r.doc_id])
    assert sum(r.predicted for r in held if not labels[r.doc_id]) <= 0.05 * len(held)
    assert all(bool(r.spans) for r in held if labels[r.doc_id])


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a vile text", "old", 7, 8), (2, None, "old", 7, 8)], "doc_id long, text string, Score string, spans int, r int")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(docs, model, with_spans=True)
    assert out.columns == ["doc_id", "text", "r", "score", "spans"]
    assert {(r.score, len(r.spans), r.r) for r in out.collect()} == {(0.0, 0, 8)}
    assert toxicity.keep_below(docs, model, 0.5).columns == docs.columns
