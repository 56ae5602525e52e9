"""8. Embedding near-dedup: a subspace pigeonhole join.

Cosine >= c means a squared distance of unit vectors of at most 2(1 - c).  A fixed
rotation spreads the distance evenly over the coordinates, which are cut into
blocks; in one block at least the squared distance is within the block's share of
that budget.  So each block is range-joined on its own: a k-d tree over its coordinates,
fitted on a bounded sample, makes cells of about ``TILE`` classes; a class goes to its own
cell and those whose box, around all their classes, is within the budget of it.  Two cells are compared by the classes that each
has within reach of the other: the block's distance selects candidates, and each
candidate is verified exactly, in the first block that selects it.  There are as many
blocks as make classes of the sample visit the fewest cells.

Equal vectors are one class with a weight before the join.  Cells that are larger all the
same are cut into tiles of bounded size, and a group compares two tiles.  A group returns link counts per
class and a spanning forest of its links, so its output is linear in its rows while
every link counts.

Vectors that are null, zero or hold null or non-finite components link with nothing:
n_links 0, their own component.  Vectors of different lengths do not link.  Rows with
a null vec_id have a null component.  Repeated rows are vectors of their own.  An
empty table gives no rows.  Columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import components, table, written
from churnlab.llm.vectors import matrix, unit, usable

#: numbers of blocks to choose from, where the vectors have so many components
BLOCKS = (2, 4, 8)
TILE = 4096
#: vectors that the k-d trees are fitted on, and their components at most; a leaf holds LEAF of them at least
SAMPLE, SAMPLE_VALUES, LEAF = 16_384, 1 << 21, 8
SLACK = 1e-7


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, threshold: float, count: int) -> list[tuple[int, int, float]]:
    """(begin, end, squared-distance budget) of each block."""
    ends = [dim * k // count for k in range(count + 1)]
    return [(b, e, 2 * (1 - threshold) * (e - b) / dim + SLACK) for b, e in zip(ends, ends[1:])]


@dataclass
class Cells:
    """A k-d tree of one block; a node is (coordinate, value, low side, high side) or a leaf's number."""

    root: tuple | int
    leaves: int

    @classmethod
    def fitted(cls, x: np.ndarray, leaves: float) -> Cells:
        """About ``leaves`` cells that hold equally many rows of x."""
        count = 0

        def node(rows: np.ndarray, wanted: float):
            nonlocal count
            if wanted > 1 and len(rows) >= 2 * LEAF:
                c = int(rows.std(axis=0).argmax())
                m = float(np.median(rows[:, c]))
                low = rows[:, c] <= m
                if 0 < low.sum() < len(rows):
                    return c, m, node(rows[low], wanted / 2), node(rows[~low], wanted / 2)
            count += 1
            return count - 1

        root = node(x, leaves)
        return cls(root, count)

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)

        def go(node, rows):
            if isinstance(node, int):
                out[rows] = node
                return
            low = x[rows, node[0]] <= node[1]
            go(node[2], rows[low])
            go(node[3], rows[~low])

        go(self.root, np.arange(len(x)))
        return out

    def within(self, x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells with a place at that squared distance of a row or nearer."""
        found, reach = [], reach_of(budget)

        def go(node, rows, far, away):
            if not len(rows):
                return
            if isinstance(node, int):
                found.append((rows, np.full(len(rows), node, np.int64)))
                return
            c, m, low, high = node
            past = x[rows, c] - m
            old = away.get(c, np.zeros(len(rows)))
            for side, gap in ((low, past), (high, -past)):
                new = np.maximum(gap, old)
                d = far - old**2 + new**2
                keep = d <= reach
                go(side, rows[keep], d[keep], {k: v[keep] for k, v in away.items()} | {c: new[keep]})

        go(self.root, np.arange(len(x)), np.zeros(len(x)), {})
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def reach_of(budget: float) -> float:
    """The budget, and more than rounding can move a row."""
    return (np.sqrt(budget) + 1e-6) ** 2


def near_box(row: np.ndarray, cell: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, cell) those whose row is within the budget of the box around the cell's own rows."""
    keep = np.zeros(len(row), bool)
    for s in range(0, len(row), 20_000):
        k = slice(s, s + 20_000)
        gap = np.maximum(np.maximum(low[cell[k]] - x[row[k]], x[row[k]] - high[cell[k]]), 0)
        keep[k] = (gap**2).sum(axis=1) <= reach_of(budget)
    return row[keep], cell[keep]


def fitted_cells(sample: np.ndarray, dim: int, threshold: float, leaves: float) -> list[Cells]:
    """The trees of each block, of the number of blocks with the fewest visits in the sample."""
    turned = unit(sample) @ rotation(dim) if len(sample) else np.zeros((0, dim))
    best, fewest = [], np.inf
    for count in [n for n in BLOCKS if n <= dim] or [1]:
        parts = blocks(dim, threshold, count)
        trees = [Cells.fitted(turned[:, b:e], leaves) for b, e, _ in parts]
        some = turned[:1024]
        visits = sum(len(t.within(some[:, b:e], budget)[0]) for t, (b, e, budget) in zip(trees, parts))
        if visits < fewest:
            best, fewest = trees, visits
    return best


def first_block(gap: np.ndarray, parts: list[tuple[int, int, float]]) -> np.ndarray:
    """The first block in which each difference of unit vectors is within the budget.

    Summed in a fixed order, so that every group that meets a pair decides alike."""
    dim = gap.shape[1]
    turn, out = rotation(dim), np.full(len(gap), len(parts))
    step = max(1, (1 << 21) // (dim * max(e - b for b, e, _ in parts)))
    for s in range(0, len(gap), step):
        left = np.arange(s, min(s + step, len(gap)))
        for k, (b, e, budget) in enumerate(parts):
            near = ((gap[left][:, :, None] * turn[None, :, b:e]).sum(axis=1) ** 2).sum(axis=1) <= budget
            out[left[near]] = k
            left = left[~near]
    return out


def links_between(x: np.ndarray, left: np.ndarray, right: np.ndarray | None, block: int, parts: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Index pairs that link and are selected in ``block`` first: among the rows
    ``left``, or between ``left`` and ``right``."""
    units = unit(x)
    b, e, budget = parts[block]
    # candidates in single precision, with more room than its rounding takes
    turned = (units @ rotation(x.shape[1])[:, b:e]).astype(np.float32)
    square, most = (turned**2).sum(axis=1), np.float32(budget + 1e-6 * (e - b + 1))
    found = [np.zeros((2, 0), np.int64)]
    others = left if right is None else right
    for i in range(0, len(left), 1024):
        rows = left[i : i + 1024]
        for j in range(i if right is None else 0, len(others), 1024):
            cols = others[j : j + 1024]
            near = (turned[rows] * np.float32(2)) @ turned[cols].T
            near = near >= (square[rows] - most)[:, None] + square[cols]
            if right is None and i == j:
                near = np.triu(near, 1)
            u, v = np.divmod(np.flatnonzero(near), len(cols))
            u, v = rows[u], cols[v]
            for s in range(0, len(u), 1 << 16):
                uu, vv = u[s : s + (1 << 16)], v[s : s + (1 << 16)]
                linked = np.einsum("ij,ij->i", units[uu], units[vv]) >= threshold
                uu, vv = uu[linked], vv[linked]
                mine = first_block(units[uu] - units[vv], parts) == block
                found.append(np.stack([uu[mine], vv[mine]]))
    return np.concatenate(found, axis=1)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees, in order."""
    above: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := above.get(i, i)) != i:
            above[i] = above.get(up, up)
            i = up
        return i

    out = []
    for a, b in pairs.T.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            above[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def link(embeddings: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    rows = usable(embeddings)
    classes = written(rows.groupBy("dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))

    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample = classes.select("dim", "v").orderBy(F.xxhash64("rep", "v"), "v").limit(max(256, min(SAMPLE, SAMPLE_VALUES // max(sizes, default=1)))).toArrow().combine_chunks()
    of_dim = sample.column("dim").to_numpy()
    cells, parts = {}, {}
    for dim, n in sorted(sizes.items()):
        mine = sample.column("v").take(pa.array(np.flatnonzero(of_dim == dim)))
        cells[dim] = fitted_cells(matrix(mine).reshape(-1, dim), dim, threshold, n / tile)
        parts[dim] = blocks(dim, threshold, len(cells[dim]))

    def turned_blocks(batches, step):
        """(dim, block, rows of some classes, their coordinates in the block)."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), step):
                    mine = batch.take(pa.array(at[i : i + step]))
                    turned = unit(matrix(mine.column("v"))) @ rotation(dim)
                    for block, (b, e, _) in enumerate(parts[dim]):
                        yield dim, block, mine, turned[:, b:e]

    def boxes(batches):
        """The number of classes in a cell and, for each coordinate, between what they lie."""
        for dim, block, _, x in turned_blocks(batches, 10_000):
            home = cells[dim][block].home(x)
            order = np.argsort(home, kind="stable")
            found, first, n = np.unique(home[order], return_index=True, return_counts=True)
            low, high = (f.reduceat(x[order], first, axis=0).ravel() for f in (np.minimum, np.maximum))
            width, many = x.shape[1], len(found) * x.shape[1]
            cols = [np.full(many, dim, np.int32), np.full(many, block, np.int32), np.repeat(found, width), np.tile(np.arange(width, dtype=np.int32), len(found)), np.repeat(n, width), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["dim", "block", "cell", "at", "n", "low", "high"])

    # the number of cells and their coordinates is bounded by that of the sample's values
    counted = classes.select("dim", "v").mapInArrow(boxes, "dim int, block int, cell long, at int, n long, low double, high double")
    counted = counted.groupBy("dim", "block", "cell", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    dim_of, block_of, cell_of, at, *values = (c.to_numpy() for c in counted.columns)
    bounds = {}
    for dim, trees in cells.items():
        for block, tree in enumerate(trees):
            k, (b, e, _) = (dim_of == dim) & (block_of == block), parts[dim][block]
            shape = (tree.leaves, e - b)
            many, low, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
            for whole, value in zip((many, low, high), values):
                whole[cell_of[k], at[k]] = value[k]
            bounds[dim, block] = np.maximum(1, -(-many[:, 0] // tile)), low, high

    def deal(batches):
        """A row for each pair of tiles that a class is compared in."""
        for dim, block, mine, x in turned_blocks(batches, 1000):
            tree, (_, _, budget) = cells[dim][block], parts[dim][block]
            many, low, high = bounds[dim, block]
            home = tree.home(x)
            own = home << 32 | (mine.column("rep").to_numpy() * 2654435761 >> 7) % many[home]
            row, cell = near_box(*tree.within(x, budget), x, low, high, budget)
            for part in range(int(many.max())):
                k = np.flatnonzero(part < many[cell])
                for s in range(0, len(k), 20_000):
                    rows, other = row[k[s : s + 20_000]], cell[k[s : s + 20_000]] << 32 | part
                    take = mine.take(pa.array(rows))
                    key = [pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), block, np.int32))]
                    key += [pa.array(np.minimum(own[rows], other)), pa.array(np.maximum(own[rows], other)), pa.array(own[rows])]
                    yield pa.RecordBatch.from_arrays([*key, take.column("rep"), take.column("weight"), take.column("v")], names=["dim", "block", "low", "high", "tile", "rep", "weight", "v"])

    def compare(table: pa.Table) -> pa.Table:
        x, block = matrix(table.column("v")), table.column("block")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        tile_of = table.column("tile").to_numpy()
        reps, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        left = np.flatnonzero(tile_of == low)
        pairs = links_between(x, left, None if low == high else np.flatnonzero(tile_of == high), block, parts[x.shape[1]], threshold)
        n = np.bincount(pairs[0], weight[pairs[1]], len(reps)) + np.bincount(pairs[1], weight[pairs[0]], len(reps))
        some = np.flatnonzero(n)
        trees = forest(reps[pairs])
        a = np.concatenate([reps[some], np.array([a for a, _ in trees], np.int64)])
        b = np.concatenate([np.full(len(some), -1), np.array([b for _, b in trees], np.int64)])
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(trees), np.int32)])
        return pa.table({"kind": kind, "a": a.astype(np.int64), "b": b.astype(np.int64), "n": np.concatenate([n[some], np.zeros(len(trees))]).astype(np.int64)})

    # single-precision vectors travel as such; all sums are in double precision
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    narrow = classes.select("dim", "rep", "weight", F.col("v").cast(f"array<{kind}>").alias("v"))
    dealt = narrow.mapInArrow(deal, f"dim int, block int, low long, high long, tile long, rep long, weight long, v array<{kind}>")
    found = written(dealt.groupBy("dim", "block", "low", "high").applyInArrow(compare, "kind int, a long, b long, n long"))
    roots = components(found.filter("kind = 1").select("a", "b"))
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    of_class = (
        classes.join(counts, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("dim", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked = rows.join(of_class, ["dim", "v"]).select("vec_id", "n_links", "component_id")
    key = F.col("vec_id").cast("long")
    alone = embeddings.select(key.alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    alone = alone.filter("vec_id is null or v is null or not coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')), false) or not coalesce(exists(v, x -> x <> 0), false)")
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
root AS (SELECT x, least(x, min(y)) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
    coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN root ON root.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
