"""12. Ranked lexical search: the best documents for each item, exactly, by a dual-tree search.

A document's coordinate at a term is what the term gives it before its weight,
(10^9 tf) div (1000 tf + 20 m); an item's coordinate is the term's weight.  A score is
their product summed over terms.  Items and documents are each put in a hierarchy whose
nodes hold the largest value of every coordinate, so the product of two nodes bounds the
scores of all their pairs.  A pair of nodes whose bound is below the weakest kth score of
the node's items is left out whole; a bound that equals it isn't, as ties go by doc_id.

Two passes over the documents a block of items.  The first reads every whole text and
writes, for each document with a term of the block, its length and its counts of the
block's terms, and as last rows of each task the task's sums for N, L and df.  The second
searches these rows: each task builds hierarchies over batches of documents, meets them
with the items' hierarchy and returns at most k documents an item.  Each task begins with
the kth scores among ``SEED_DOCS`` documents, which the driver has searched in the same way;
they are lower bounds and change no result.  Spark merges the tasks' documents, first by
item and a hash of the document, then by item.

Items are taken in blocks of about ``BLOCK_CHARS`` characters, so the broadcast vocabulary
is bounded however many items there are.  Rows of the items with equal id and text are one
item; one id with several texts has a ranking for each.  Null and empty texts have no terms:
such items have no rows, such documents don't count in N.  Every row of the documents counts
and is ranked by itself, repeated ones as well; a null doc_id comes after all others of the
same score.  Very long texts are read whole, a task holds one batch of them.  Empty tables
give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.llm.common import removed, table, written, written_at

K = 50
BLOCK_CHARS = 4_000_000
SEED_DOCS = 4096
LEAF_DOCS, FAN_DOCS = 4, 8
LEAF_ITEMS, FAN_ITEMS = 1, 8
MERGE_SALT = 64

# A-Z to a-z, 0-9 and a-z and bytes of other characters stay, all else separates
BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


@dataclass
class Items:
    """The items of a block: ids, numbers of their terms, the terms' numbers."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[Items]:
    """The distinct items in blocks by a hash of the row."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // block_chars)
    for b in range(n):
        found = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b).orderBy(F.xxhash64("k", "t")).collect()
        vocabulary: dict[bytes, int] = {}
        own = [np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(r["t"])]).astype(np.int64) for r in found]
        some = [i for i, t in enumerate(own) if len(t)]
        if some:
            yield Items([found[i]["k"] for i in some], [own[i] for i in some], vocabulary)


PROFILE = "doc_id long, n long, terms array<int>, counts array<int>, term int, df long, docs long, words long"


def profile(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of documents (doc_id, n, terms, counts) and, at each task's end, of its sums by
    term (term, df) and in all (docs, words)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the block
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        df, docs_seen, words_seen = np.zeros(len(held.value), np.int64), 0, 0
        for batch in batches:
            keep, lengths, cuts, terms, counts = [], [], [0], [], []
            for i in range(batch.num_rows):
                words = terms_of(batch.column(1)[i].as_py())
                if not words:
                    continue
                docs_seen, words_seen = docs_seen + 1, words_seen + len(words)
                hits = Counter(map(get, words))
                hits.pop(None, None)
                if hits:
                    keep.append(i)
                    lengths.append(len(words))
                    terms += hits.keys()
                    counts += hits.values()
                    cuts.append(len(terms))
            df += np.bincount(np.array(terms, np.int64), minlength=len(df))
            if keep:
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield rows({"doc_id": batch.column(0).take(pa.array(keep)), "n": pa.array(lengths, pa.int64()), "terms": lists[0], "counts": lists[1]}, len(keep))
        if docs_seen:
            yield rows({"docs": pa.array([docs_seen]), "words": pa.array([words_seen])}, 1)
            some = np.flatnonzero(df)
            yield rows({"term": pa.array(some.astype(np.int32)), "df": pa.array(df[some])}, len(some))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PROFILE)


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges in a row, and where each range begins among them."""
    size = end - begin
    at = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - at, size), at


@dataclass
class Coordinates:
    """Sparse rows: row i has terms[cut[i]:cut[i + 1]] with values, at least one."""

    cut: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def maxima(self, fan: int) -> Coordinates:
        """The coordinatewise maxima of each ``fan`` rows in a row."""
        node = np.repeat(np.arange(len(self.cut) - 1) // fan, np.diff(self.cut))
        order = np.lexsort((self.terms, node))
        node, terms = node[order], self.terms[order]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (terms[1:] != terms[:-1])]))
        cut = np.searchsorted(node[first], np.arange(node[-1] + 2))
        return Coordinates(cut, terms[first], np.maximum.reduceat(self.values[order], first))

    def products(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The rows' products with a vector over all terms."""
        at, begin = ranges(self.cut[rows], self.cut[rows + 1])
        return np.add.reduceat(weights[self.terms[at]] * self.values[at], begin)


@dataclass
class Node:
    """A node over the items lo to hi of the order; its coordinates are the weights of ``terms``."""

    lo: int
    hi: int
    terms: np.ndarray
    children: list[Node] = field(default_factory=list)


@dataclass
class Search:
    """Everything a task needs: the items in the order of their hierarchy, weights, N and L, kth scores to begin with."""

    terms: list[np.ndarray]
    weights: np.ndarray
    root: Node
    docs: int
    words: int
    k: int
    least: np.ndarray


def hierarchy(terms: list[np.ndarray]) -> Node:
    nodes = [Node(i, min(i + LEAF_ITEMS, len(terms)), np.unique(np.concatenate(terms[i : i + LEAF_ITEMS]))) for i in range(0, len(terms), LEAF_ITEMS)]
    while len(nodes) > 1:
        groups = [nodes[i : i + FAN_ITEMS] for i in range(0, len(nodes), FAN_ITEMS)]
        nodes = [Node(g[0].lo, g[-1].hi, np.unique(np.concatenate([c.terms for c in g])), g) for g in groups]
    return nodes[0]


def impacts(n: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) per count, m of its document being 50 + (50 n N) div L."""
    if len(n) and int(n.max()) * 50 * docs >= 2**62:
        m = np.array([50 + 50 * int(x) * docs // words for x in n], np.int64)
    else:
        m = 50 + 50 * n * docs // words
    tf = counts.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 20 * m[doc])


class Best:
    """The k best documents of each item so far, and the score that a document needs."""

    def __init__(self, search: Search):
        self.k, self.least = search.k, search.least.copy()
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in search.terms]

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(p) for p in zip(self.held[item], (score, doc, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.held[item] = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], score[order[-1]])


class Batch:
    """The hierarchy over a batch of documents, and its meeting with the items' hierarchy."""

    def __init__(self, search: Search, best: Best, doc: np.ndarray, null: np.ndarray, n: np.ndarray, rows: Coordinates):
        self.search, self.best, self.scored = search, best, 0
        row = np.repeat(np.arange(len(n)), np.diff(rows.cut))
        value = impacts(n, rows.values, row, search.docs, search.words)
        # documents alike in their commonest term, then in the term that gives most, are neighbours
        lead = rows.terms[np.lexsort((rows.terms, -rows.values, row))[rows.cut[:-1]]]
        most = rows.terms[np.lexsort((rows.terms, -value * search.weights[rows.terms], row))[rows.cut[:-1]]]
        order = np.lexsort((n, most, lead))
        at, begin = ranges(rows.cut[order], rows.cut[order + 1])
        self.doc, self.null = doc[order], null[order]
        self.levels = [Coordinates(np.append(begin, len(at)), rows.terms[at], value[at])]
        self.levels.append(self.levels[0].maxima(LEAF_DOCS))
        while len(self.levels[-1].cut) - 1 > FAN_DOCS:
            self.levels.append(self.levels[-1].maxima(FAN_DOCS))
        self.scratch = np.zeros(len(search.weights), np.int64)

    def products(self, level: int, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        self.scratch[terms] = self.search.weights[terms]
        out = self.levels[level].products(rows, self.scratch)
        self.scratch[terms] = 0
        return out

    def members(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The rows of the level below in the nodes of a level."""
        fan = LEAF_DOCS if level == 1 else FAN_DOCS
        return ranges(nodes * fan, np.minimum((nodes + 1) * fan, len(self.levels[level - 1].cut) - 1))[0]

    def run(self) -> None:
        top = len(self.levels) - 1
        self.visit(self.search.root, top, np.arange(len(self.levels[top].cut) - 1))

    def visit(self, node: Node, level: int, nodes: np.ndarray) -> None:
        bounds = self.products(level, nodes, node.terms)
        keep = (bounds > 0) & (bounds >= self.best.least[node.lo : node.hi].min())
        nodes, bounds = nodes[keep], bounds[keep]
        if not len(nodes):
            return
        if level == 1 and not node.children:
            order = np.argsort(-bounds, kind="stable")
            return self.score(node, nodes[order], bounds[order])
        if level > 1:
            level, nodes = level - 1, self.members(level, nodes)
        for child in node.children or [node]:
            self.visit(child, level, nodes)

    def score(self, node: Node, leaves: np.ndarray, bounds: np.ndarray) -> None:
        """Scores the items of a leaf on leaves of documents, in growing runs from the highest bound on."""
        at, size = 0, 8
        while at < len(leaves) and bounds[at] >= self.best.least[node.lo : node.hi].min():
            rows = self.members(1, leaves[at : at + size])
            for item in range(node.lo, node.hi):
                score = self.products(0, rows, self.search.terms[item])
                good = np.flatnonzero((score > 0) & (score >= self.best.least[item]))
                if len(good):
                    self.best.add(item, score[good], self.doc[rows[good]], self.null[rows[good]])
            self.scored += len(rows) * (node.hi - node.lo)
            at, size = at + size, 2 * size


def batch_of(search: Search, best: Best, doc, null, n, terms, counts, cut) -> Batch:
    return Batch(search, best, doc, null, n, Coordinates(cut, terms.astype(np.int64), counts.astype(np.int64)))


def seeds(rows: DataFrame, search: Search, seed_docs: int) -> np.ndarray:
    """kth scores among a bounded number of documents."""
    got = rows.select("doc_id", "n", "terms", "counts").limit(seed_docs).collect()
    best = Best(search)
    if got:
        cut = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in got])])
        flat = [np.fromiter((x for r in got for x in r[c]), np.int64, cut[-1]) for c in ("terms", "counts")]
        zeros = np.zeros(len(got), np.int64)  # which documents they are doesn't matter
        batch_of(search, best, zeros, zeros > 0, np.array([r["n"] for r in got]), *flat, cut).run()
    return best.least


def found_by_tasks(rows: DataFrame, search: Search) -> DataFrame:
    """(item, doc_id, score): of each task at most k documents an item."""
    held = rows.sparkSession.sparkContext.broadcast(search)  # bounded by the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = held.value
        best = Best(search)
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, counts = batch.column("terms"), batch.column("counts")
            cut = terms.offsets.to_numpy().astype(np.int64)
            doc = batch.column("doc_id")
            null = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            flat = [x.flatten().to_numpy() for x in (terms, counts)]
            batch_of(search, best, doc, null, batch.column("n").to_numpy(), *flat, cut - cut[0]).run()
        for item, (score, doc, null) in enumerate(best.held):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def search_block(docs: DataFrame, items: Items, key: str, text: str, k: int, seed_docs: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items of a block."""
    spark = docs.sparkSession
    table_, path = written_at(profile(docs, key, text, items.vocabulary))
    totals = table_.filter("docs is not null").agg(F.sum("docs"), F.sum("words")).first()
    n, words = totals[0] or 0, totals[1] or 0
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in table_.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    # items alike in their commonest terms are neighbours
    order = sorted(range(len(items.ids)), key=lambda i: (-np.sort(-df[items.terms[i]])[:4]).tolist())
    terms = [items.terms[i] for i in order]
    search = Search(terms, weights, hierarchy(terms), n, words, k, np.zeros(len(terms), np.int64))
    rows = table_.filter("terms is not null")
    search.least = seeds(rows, search, seed_docs)
    found = found_by_tasks(rows, search)
    for part in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALT))], ["item"]):
        best = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = written(found.select("item", "rank", "doc_id", "score"))
    removed(spark, path)
    ids = spark.createDataFrame([(n, items.ids[i]) for n, i in enumerate(order)], "item int, item_id long")
    return out.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # ids: bounded by the block


def search(
    docs: DataFrame, items: DataFrame, k: int = K, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    block_chars: int = BLOCK_CHARS, seed_docs: int = SEED_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items.withColumn(item_key, F.col(item_key).cast("long")), item_key, text, block_chars):
        out = out.unionByName(search_block(docs, block, doc_key, text, k, seed_docs))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, unnest({_TERMS}) AS term FROM d),
total AS (SELECT count(DISTINCT r) AS nd, count(*) AS nw FROM w),
size AS (SELECT r, count(*) AS n FROM w GROUP BY r),
item AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM w SEMI JOIN item USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, nd),
impact AS (SELECT doc_id, r, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nw)) AS impact FROM tf JOIN size USING (r), total),
scored AS (SELECT item_id, r, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM item JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {K}
"""
