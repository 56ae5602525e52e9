"""Brute force and edge rows for the operators on embeddings, and the pipeline."""

import numpy as np
import pytest

from churnlab.llm import embedding_dedup, vector_search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    near = base[:60] + 0.05 * rng.standard_normal((60, 16))
    x = np.concatenate([base, near, base[:5]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [nan] * 16, 1), (1003, [inf] + [1.0] * 15, 1), (1004, [None] + [1.0] * 15, 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (None, [1.0] * 16, 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def test_embedding_links_equal_brute_force(spark, vectors):
    x, df = vectors
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df, tile=64).collect()}
    near = cosines(x) >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(1000, 1005)) and got[1006] == (1, 1005, False)
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_vector_search_recall(spark, vectors):
    x, df = vectors
    near = cosines(x)
    np.fill_diagonal(near, -2)
    rows = vector_search.search(df, df.filter("vec_id % 10 = 0")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for i in range(0, len(x), 10):
        best = np.lexsort((np.arange(len(x)), -near[i]))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in found[i].values()})
        assert sorted(found[i]) == [1, 2, 3, 4, 5]
        assert all(abs(near[i][v] - s) < 1e-12 for v, s in found[i].values())
    assert hits / (5 * len(range(0, len(x), 10))) >= 0.9
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_vector_search_of_repeated_ids_ties_and_extreme_sizes(spark):
    """Against all pairs: rows of one id and vector are one, equal scores go by vec_id, and
    vectors of 1e-200 and 1e200 have their cosines."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(50, base[50].tolist()), (50, base[50].tolist()), (50, base[7].tolist()), (7, base[7].tolist())]
    rows += [(70 + i, base[20].tolist()) for i in range(8)]
    rows += [(100, (base[3] * 1e-200).tolist()), (101, (base[3] * 1e200).tolist()), (150, (base[4] * 1e-200).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in once]), np.array([v for _, v in once])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    near = cosines(x)
    want = []
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            near[i, i] = -2
            best = np.lexsort((ids, -np.round(near[i], 12)))[:5]
            want += [(int(ids[i]), n, round(float(near[i][b]), 9)) for n, b in enumerate(best, 1)]
    got = vector_search.search(df, df.filter("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], round(r.score, 9)) for r in got) == sorted(want)
    ties = [r.vec_id for r in vector_search.search(df, df.filter("vec_id = 20")).collect()]
    assert ties == [70, 71, 72, 73, 74]


def test_pipeline_stages_with_odd_rows_and_names(spark):
    """Empty tables, null rows, and columns named like the stages' own helpers."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _place string, _spans int, score string, _toxic int, r int, c0 int"
    rows = [(1, text), (2, text), (2, text), (3, " ".join(f"before{i}" for i in range(60)) + " " + text + " and after"), (4, None), (None, "no id"), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "a", "b", 1, "x", 2, 3, 4) for i, t in rows], schema)
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, sf)
            if name == "packing":
                break
            assert out.columns == docs.columns, name
            part = corpus_pipeline.written(out)
        kept = {r.doc_id: r for r in part.collect()}
        if kept:
            assert set(kept) == {1, 3, 4, 5, None} and kept[1].text == text and text not in kept[3].text
            assert all((r._id, r._place, r._spans, r.score, r._toxic, r.r, r.c0) == ("a", "b", 1, "x", 2, 3, 4) for r in kept.values())
        assert out.count() >= len(kept)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns and first.count() <= docs.count()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
