"""3. Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of vectors (``SAMPLE_ROWS``, the lowest hashes
of their ids) and every vector is put into a leaf.  A query keeps the branches not yet
taken in a priority queue by the cosine of their centres and visits leaves in that
order.  The number of leaves is widened until the recall on sampled queries, against
brute force over the sample, reaches ``RECALL``; then all rows of the visited leaves are
compared exactly.  Leaves are cut into chunks of bounded size, so a crowded leaf is
searched by several tasks.

Vectors that are null, zero or hold null or non-finite components, or have a null id,
take no part.  A row never finds rows of its own vec_id.  Equal scores go to the
smaller vec_id.  Vectors of other lengths than the commonest in the sample are searched
among their own length by brute force over one leaf.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.llm.common import table, written
from churnlab.llm.vectors import matrix, unit, usable

SAMPLE_ROWS = 16_384
LEAF_ROWS = 96
BRANCHES = 8
RECALL = 0.97
CALIBRATION_QUERIES = 512
CHUNK = 8192


@dataclass
class Tree:
    """Nodes by number; the children of node i are ``children[i]``, leaves have none."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0
    visits: int = 1

    def grow(self, x: np.ndarray, rng: np.random.Generator) -> int:
        """Adds the subtree of the unit vectors x and returns its root."""
        me = len(self.centres)
        self.centres.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        label = self._split(x, rng) if len(x) > LEAF_ROWS else None
        if label is None:
            self.leaf[me], self.leaves = self.leaves, self.leaves + 1
        else:
            for c in np.unique(label):
                self.children[me].append(self.grow(x[label == c], rng))
        return me

    @staticmethod
    def _split(x: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray | None:
        """Lloyd's k-means from distinct rows; None where the rows can't be told apart."""
        start = np.unique(x[rng.choice(len(x), min(len(x), 4 * BRANCHES), replace=False)], axis=0)
        if len(start) < 2:
            start = np.unique(x, axis=0)
            if len(start) < 2:
                return None
        centres = start[rng.permutation(len(start))[:BRANCHES]]
        for _ in range(rounds):
            label = nearest(x, centres)
            centres = np.stack([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        label = nearest(x, centres)
        return label if len(np.unique(label)) > 1 else None

    def put(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at each node."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            label = nearest(x[rows], np.stack([self.centres[c] for c in self.children[node]]))
            todo += [(c, rows[label == i]) for i, c in enumerate(self.children[node]) if (label == i).any()]
        return out

    def order(self, near: np.ndarray):
        """Leaves best bin first; ``near``: minus the squared distance of the query to each centre."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                ranked = sorted(self.children[node], key=lambda c: -near[c])
                for c in ranked[1:]:
                    heapq.heappush(queue, (-near[c], c))
                node = ranked[0]
            yield self.leaf[node]


def closeness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Minus the squared distance, but for a term that is the same for all centres."""
    return 2 * x @ centres.T - (centres**2).sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return closeness(x, centres).argmax(axis=1)


def fit(x: np.ndarray, k: int) -> Tree:
    """A tree over the sample, and how many leaves a query visits for the recall wanted."""
    tree = Tree()
    tree.grow(x, np.random.default_rng(11))
    leaf, centres = tree.put(x), np.stack(tree.centres)
    queries = np.arange(0, len(x), max(1, len(x) // CALIBRATION_QUERIES))
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    at = np.zeros(best.shape, np.int64)  # when the leaf of each true neighbour is visited
    for i, ranks in enumerate(closeness(x[queries], centres)):
        place = np.empty(tree.leaves, np.int64)
        place[list(tree.order(ranks))] = np.arange(tree.leaves)
        at[i] = place[leaf[best[i]]]
    tree.visits = 1
    while tree.visits < tree.leaves and (at < tree.visits).mean() < RECALL:
        tree.visits += 1
    return tree


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of ``embeddings`` found
    for each row of ``queries``; both have vec_id and embedding.

    Rows with the same vec_id and vector are one row, as queries and as candidates; a query's
    own row is no candidate, a row of its vec_id with another vector is.  Equal scores are
    ordered by vec_id.  Vectors of any finite size are compared without over- or underflow,
    those of another length only with each other.  Other columns are ignored."""
    rows, asked = usable(embeddings), usable(queries).dropDuplicates(["vec_id", "v"])
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)  # bounded by the parameter
    got = sampled.select("dim", "v").toArrow()
    dims = got.column("dim").to_numpy()
    if not len(dims):
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    main = int(np.bincount(dims).argmax())
    tree = fit(unit(matrix(got.filter(pa.array(dims == main)).column("v"))), k)
    held = embeddings.sparkSession.sparkContext.broadcast(tree)  # its size is bounded by the sample's

    def put(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            leaf = np.full(len(dim), -1, np.int32)  # other lengths: a leaf of their own
            mine = np.flatnonzero(dim == main)
            if len(mine):
                leaf[mine] = held.value.put(unit(matrix(batch.column("v").take(pa.array(mine)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = written(rows.select("vec_id", "dim", "v").mapInArrow(put, "vec_id long, dim int, v array<double>, leaf int"))
    # one row a leaf: bounded by the sample
    sizes = {(r["dim"], r["leaf"]): r["count"] for r in placed.groupBy("dim", "leaf").count().collect()}
    chunks = {key: -(-n // CHUNK) for key, n in sizes.items()}

    def visit(batches):
        tree, centres = held.value, np.stack(held.value.centres)
        for batch in batches:
            ids, dim, out = batch.column("vec_id").to_pylist(), batch.column("dim").to_numpy(), []
            mine = np.flatnonzero(dim == main)
            x = unit(matrix(batch.column("v").take(pa.array(mine)))) if len(mine) else None
            ranks = dict(zip(mine.tolist(), closeness(x, centres))) if len(mine) else {}
            for i in range(len(ids)):
                leaves, n, met = [], 0, 0
                for leaf in tree.order(ranks[i]) if i in ranks else [-1]:
                    # as many leaves as calibrated, and on while they hold too few rows
                    if n >= tree.visits and met > k:
                        break
                    leaves.append(leaf)
                    n, met = n + 1, met + sizes.get((int(dim[i]), leaf), 0)
                out += [(i, leaf, c) for leaf in leaves for c in range(chunks.get((int(dim[i]), leaf), 0))]
            for s in range(0, len(out), 20_000):
                at, leaf, chunk = zip(*out[s : s + 20_000])
                take = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(take.column(c) for c in ("vec_id", "ask", "dim", "v")), pa.array(leaf, pa.int32()), pa.array(chunk, pa.int32())], names=["query_id", "ask", "dim", "v", "leaf", "chunk"])

    # queries of one id with several vectors are told apart by the vector's hash
    asked = asked.select("vec_id", F.xxhash64("v").alias("ask"), "dim", "v")
    asking = asked.mapInArrow(visit, "query_id long, ask long, dim int, v array<double>, leaf int, chunk int")
    parts = [F.when((F.col("dim") == d) & (F.col("leaf") == leaf), F.lit(n)) for (d, leaf), n in chunks.items() if n > 1]
    holding = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.coalesce(*parts, F.lit(1))).cast("int"))

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"query_id": [], "ask": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, v = matrix(left.column("v")), matrix(right.column("v"))
            asks, hashes, ids = left.column("query_id").to_numpy(), left.column("ask").to_numpy(), right.column("vec_id").to_numpy()
            if len(np.unique(ids)) < len(ids):  # rows of one id and vector count once
                once = np.unique(np.concatenate([ids[:, None].view(np.float64), v], axis=1).view(np.int64), axis=0, return_index=True)[1]
                v, ids = v[once], ids[once]
            u, x = unit(v), unit(q)
            for s in range(0, len(q), 512):
                score = x[s : s + 512] @ u.T
                for i, j in zip(*np.nonzero(asks[s : s + 512][:, None] == ids)):
                    if (q[s + i] == v[j]).all():  # the query's own row
                        score[i, j] = -np.inf
                # the k-th best score, then all that reach it: ties are settled by id
                cut = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                at, of = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
                order = np.lexsort((ids[of], -score[at, of], at))
                at, of = at[order], of[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, of = at[place < k], of[place < k]
                found["query_id"].append(asks[s + at])
                found["ask"].append(hashes[s + at])
                found["vec_id"].append(ids[of])
                found["score"].append(score[at, of])
        return pa.table({c: np.concatenate(x) if x else np.zeros(0, float if c == "score" else np.int64) for c, x in found.items()})

    met = asking.groupBy("dim", "leaf", "chunk").cogroup(holding.groupBy("dim", "leaf", "chunk")).applyInArrow(compare, "query_id long, ask long, vec_id long, score double")
    # at most k rows from each visited chunk
    best = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
