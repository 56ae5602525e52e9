"""Op 8's cells: which tiles are compared, against brute force."""

import numpy as np
import pytest

from churnlab.llm import embedding_dedup
from churnlab.llm.vectors import unit

DIM, THRESHOLD = 64, 0.95


def vectors(clustered: bool, n: int = 4000) -> np.ndarray:
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, DIM))
    if clustered:
        x = 0.05 * x + rng.standard_normal((40, DIM))[rng.integers(0, 40, n)]
    copies = x[: n // 8] + rng.uniform(0, 0.3, (n // 8, 1)) * rng.standard_normal((n // 8, DIM)) * np.linalg.norm(x[: n // 8], axis=1, keepdims=True) / 8
    return np.concatenate([x, copies])


@pytest.mark.parametrize("clustered,most", [(False, 2.0), (True, 0.2)])
def test_cells_compare_no_pair_that_is_far_and_all_that_link(clustered, most):
    """Comparisons in all blocks, as a share of all pairs: with a grid on two coordinates it
    was 3.4 on such vectors without clusters."""
    units = unit(vectors(clustered))
    turned, n = units @ embedding_dedup.rotation(DIM), len(units)
    cells = embedding_dedup.fitted_cells(units[:2000], DIM, THRESHOLD, leaves=n / 256)
    compared, met = 0, np.zeros((n, n), bool)
    for tree, (b, e, budget) in zip(cells, embedding_dedup.blocks(DIM, THRESHOLD, len(cells))):
        x = turned[:, b:e]
        home = tree.home(x)
        low, high = (np.array([f(x[home == k], axis=0) for k in range(tree.leaves)]) for f in (np.min, np.max))
        row, cell = embedding_dedup.near_box(*tree.within(x, budget), x, low, high, budget)
        reaches = np.zeros((n, tree.leaves), bool)
        reaches[row, cell] = True
        assert tree.leaves > 8 and reaches[np.arange(n), home].all()
        both = reaches[:, home] & reaches[:, home].T
        compared += np.triu(both, 1).sum()
        square = (x**2).sum(axis=1)
        met |= both & (square[:, None] + square - 2 * x @ x.T <= budget)
    links = units @ units.T >= THRESHOLD
    assert links.sum() > n and not (links & ~met).any()
    assert compared <= most * n * (n - 1) / 2


@pytest.mark.parametrize("clustered", [False, True])
def test_links_across_cells_and_tiles_equal_brute_force(spark, clustered):
    """Crowded cells (clusters) are cut into tiles on top; every link counts once."""
    x = vectors(clustered, 1200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(df, tile=100).collect()}
    near = unit(x) @ unit(x).T >= THRESHOLD
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root, len(x)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert got == {i: (near[i].sum(), root[i]) for i in range(len(x))}
