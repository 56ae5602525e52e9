"""10. N-gram Jaccard join: token-combination prefixes, then verification.

A document's tokens are its distinct five-word shingles.  Two documents link if
100 * |intersection| >= 80 * |union|; then each misses at most m = n - ceil(0.8 n) of its n
tokens.  All tokens have one order, rare ones (by hash) before frequent ones (by their
count, then by hash).  So the first common token of a linked pair is among the first m + 1 of both, and
their k first common tokens are among the first m + k of both:

* if the first common token is rare, both index it as a single token;
* else no rare token is common, so neither has more than m rare tokens, and both index
  each k-combination of the frequent tokens among their first m + k.

Frequent are tokens counted in more than about one of ``FREQUENT_SHARE`` of all token
occurrences, counted over all documents, so their number is bounded whatever the input
and they can be broadcast; any choice of them gives the same links.  k is 2 for small
documents, and 1 for those whose prefix would have too many pairs; a combination is
indexed by the size class of the larger document, so both sides use the same k.

Documents with equal shingle sets are one class before the join.  Candidates are
verified exactly, in rounds: first each index key's pivot with its other members,
then, after linked documents were joined to components, all pairs of a key that are
still in different components.  A group of copies or near copies is thus compared with
its pivots and never paired with itself.  Before texts are compared, a bound on the
intersection from bitmaps of token parities drops pairs that can't link.

Texts without words and null texts have no shingles and link with nothing; with fewer
than five words the whole sequence is one shingle.  Repeated rows are copies.  Rows with
a null doc_id get n_shingles and a null component.  An empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.llm.common import MIX, components, free_name, mixed, shingle_hashes, table, words_of, written

WIDTH = 5
#: a token is frequent from total / FREQUENT_SHARE occurrences (and FREQUENT_LEAST) on
FREQUENT_SHARE = 1 << 20
FREQUENT_LEAST = 64
#: pairs of frequent tokens are indexed up to this many tokens in the prefix, else single ones
PAIR_PREFIX = 16
#: rounds with other pivots before the pairs still apart are compared one by one
PIVOT_ROUNDS = 1
#: up to this many candidate ids are broadcast to pick their texts, beyond it they are joined
BROADCAST_IDS = 500_000


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), WIDTH))


def parities(tokens: np.ndarray) -> bytes:
    """Bit h mod B is whether an odd number of tokens has it; B is a power of two from the
    set's size on, so that sets of other sizes fold onto it."""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from two bitmaps."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    la, lb = 8 * len(a), 8 * len(b)
    while la > lb:
        la //= 2
        x = (x & ((1 << la) - 1)) ^ (x >> la)
    while lb > la:
        lb //= 2
        y = (y & ((1 << lb) - 1)) ^ (y >> lb)
    return (x ^ y).bit_count()


def least_common(na: int, nb: int) -> int:
    """The smallest intersection with 100 * intersection >= 80 * union."""
    return -(-4 * (na + nb) // 9)


def misses(n: int) -> int:
    return n - -(-4 * n // 5)


def size_class(n: int) -> int:
    """Sizes of a linked pair are within 4 : 5, so at most one class apart."""
    return int(np.log(n) / np.log(1.25) + 1e-9)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(single rare tokens, keys of frequent combinations) that a set is indexed by; and
    how many rare tokens it has."""
    n, m = len(tokens), misses(len(tokens))
    common, place = np.zeros(n, bool), np.zeros(n, np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[place] == tokens
    rare = tokens[~common]  # in order of hash
    if len(rare) > m:
        return rare[: m + 1], np.zeros(0, np.uint64), len(rare)
    often, own = tokens[common][np.argsort(ranks[place[common]])], []
    for c in (size_class(n), size_class(n) + 1):
        # the class alone decides on k, so both documents of a pair decide alike
        k = 2 if misses(int(1.25 ** (c + 1)) + 1) + 2 <= PAIR_PREFIX else 1
        part = often[: max(0, m + k - len(rare))]
        salt = np.uint64(xxhash.xxh3_64_intdigest(f"{c},{k}"))
        if k == 1:
            own.append(mixed(part ^ salt))
        else:  # different sets that link have four tokens in common at least
            i, j = np.triu_indices(len(part), 1)
            own.append(mixed(part[i] * MIX + part[j] ^ salt))
    return rare[: m + 1], np.unique(np.concatenate(own)), len(rare)


def texts_in(batches, rows: int = 500):
    """(ids, shingle sets) of some rows at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(0, len(ids), rows):
            yield ids[i : i + rows].to_pylist(), [shingle_set(t) for t in texts[i : i + rows].to_pylist()]


#: a set's parities folded to this many words of 64 bits, compared inside Spark's join
FOLDS = 4


def folded(tokens: np.ndarray) -> list[int]:
    """Parities of the tokens by their lowest bits, as FOLDS signed 64-bit words."""
    odd = np.bincount((tokens & np.uint64(64 * FOLDS - 1)).astype(np.int64), minlength=64 * FOLDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


FOLD_COLUMNS = [f"p{i}" for i in range(FOLDS)]


def described(docs: DataFrame) -> DataFrame:
    """For each document (kind 0) its number of shingles, their digest and bitmaps; and
    (kind 1) tokens that several documents of a task have, with their counts there."""
    names = ["kind", "id", "n", "digest", "bits", *FOLD_COLUMNS]

    def run(batches):
        held, n_held = [], 0

        def counted():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(2, n_held >> 20)
            k = int(often.sum())
            none = pa.nulls(k, pa.binary())
            folds = [pa.nulls(k, pa.int64())] * FOLDS
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(tokens[often].view(np.int64)), pa.array(counts[often]), none, none, *folds], names=names)

        for ids, sets in texts_in(batches):
            n = np.array([len(s) for s in sets], np.int64)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            bits = pa.array([parities(s) if len(s) else b"" for s in sets], pa.binary())
            folds = [pa.array(c, pa.int64()) for c in zip(*map(folded, sets))] or [pa.nulls(0, pa.int64())] * FOLDS
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(ids, pa.int64()), pa.array(n), pa.array(digest, pa.binary()), bits, *folds], names=names)
            held += sets
            n_held += int(n.sum())
            if n_held >= 2_000_000:
                yield counted()
                held, n_held = [], 0
        if held:
            yield counted()

    return docs.mapInArrow(run, "kind int, id long, n long, digest binary, bits binary, " + ", ".join(f"{c} long" for c in FOLD_COLUMNS))


def frequent_tokens(counted: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and their ranks by count; at most FREQUENT_SHARE, as
    each has that share of all occurrences."""
    least = max(FREQUENT_LEAST, total // FREQUENT_SHARE)
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") > least).toArrow()
    tokens, n = rows.column("id").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    tokens, n = tokens[order], n[order]
    ranks = np.empty(len(tokens), np.int64)
    ranks[np.lexsort((tokens, n))] = np.arange(len(tokens))
    return tokens, ranks


def indexed(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(often, key, id, rare): the keys of all documents, within a task of equal sets once;
    with frequent keys the number of the document's rare tokens, else 0."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        seen: set[bytes] = set()
        for ids, sets in texts_in(batches):
            often, keys, of, rare = [], [], [], []
            for i, s in zip(ids, sets):
                if len(s) and i is not None and (d := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(d)
                    *both, n_rare = index_keys(s, *held.value)
                    for flag, own in enumerate(both):
                        often.append(np.full(len(own), bool(flag)))
                        keys.append(own)
                        of.append(np.full(len(own), i, np.int64))
                        rare.append(np.full(len(own), n_rare * flag, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(often)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(of)), pa.array(np.concatenate(rare))], names=["often", "key", "id", "rare"])

    return docs.mapInArrow(run, "often boolean, key long, id long, rare long")


def shared_lists(rows: DataFrame, partitions: int) -> DataFrame:
    """(members): the documents of each rare key with several, sorted; equal lists once a partition.

    A rare key has about FREQUENT_LEAST documents, or one of FREQUENT_SHARE of all occurrences."""

    def run(batches):
        got = [(b.column("key").to_numpy(), b.column("id").to_numpy()) for b in batches]
        if not got:
            return
        keys, ids = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.append(first[1:], len(keys))
        many = last - first > 1
        lists = {ids[a:b].tobytes() for a, b in zip(first[many].tolist(), last[many].tolist())}
        lists = [x for x in (np.unique(np.frombuffer(x, np.int64)) for x in lists) if len(x) > 1]
        for i in range(0, len(lists), 5000):
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in lists[i : i + 5000]], pa.list_(pa.int64()))], names=["members"])

    return rows.repartition(partitions, "key").mapInArrow(run, "members array<long>")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't rule out."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("100 * least(na, nb) >= 80 * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            bits = zip(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist())
            keep = [i for i, (x, y) in enumerate(bits) if differ_at_least(x, y) <= na[i] + nb[i] - 2 * least_common(na[i], nb[i])]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets link."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (x, y) in enumerate(zip(a, b)):
                sets = []
                for d, side in ((x, "texta"), (y, "textb")):
                    if d not in held:
                        if len(held) > 200:
                            held.clear()
                        held[d] = shingle_set(batch.column(side)[i].as_py())
                    sets.append(held[d])
                common = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * common >= 80 * (len(sets[0]) + len(sets[1]) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(described(docs), "kind")
    own, counted = rows.filter("kind = 0").drop("kind"), rows.filter("kind = 1")
    total = own.agg(F.sum("n")).first()[0] or 0
    index = written(indexed(docs, frequent_tokens(counted, total)), "often")

    # equal sets are one class, named by its smallest document
    classes = own.filter("n > 0 and id is not null").groupBy("digest", "n").agg(F.min("id").alias("rep"))
    member = own.filter("n > 0 and id is not null").join(classes, ["digest", "n"]).select("id", "rep", "n", "bits", *FOLD_COLUMNS)
    member = written(member.dropDuplicates(["id"]))
    nodes, rep_of = member.filter("id = rep"), member.select("id", "rep")

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // 5_000_000)
    lists = shared_lists(index.filter("not often").select("key", "id"), partitions).distinct()
    lists = lists.select(F.xxhash64("members").alias("list"), F.explode("members").alias("id"))
    lists = lists.join(rep_of, "id").selectExpr("list", "rep", "0L AS rare").distinct()
    often = index.filter("often").select(F.col("key").alias("list"), "id", "rare").join(rep_of, "id").select("list", "rep", "rare").distinct()
    groups = lists.withColumn("often", F.lit(False)).unionByName(often.withColumn("often", F.lit(True)))
    several = groups.groupBy("often", "list").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    groups = groups.join(several.select("often", "list"), ["often", "list"])
    # every row of a key that several classes share; the more keys a class has, the
    # closer it is to what its group has in common
    groups = written(groups.join(groups.groupBy("rep").agg(F.count("*").alias("weight")), "rep"))

    ids = groups.select(F.col("rep").alias("doc_id")).distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = written(docs.join(wanted, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.first("text").alias("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").filter("a < b").distinct()
        return written(linked(written(possible(pairs, nodes)), texts))

    def with_pivots(rows: DataFrame, *orders: str) -> DataFrame:
        """Each row of a key with the key's member that is largest in each of the orders."""
        pivots = rows.groupBy("often", "list").agg(F.array_distinct(F.array(*[F.expr(f"max_by(rep, {o})") for o in orders])).alias("pivots"))
        met = rows.join(pivots, ["often", "list"]).withColumn("a", F.explode("pivots"))
        if "root" not in rows.columns:
            return met.selectExpr("a", "rep AS b")
        of_pivot = rows.select("often", "list", F.col("rep").alias("a"), F.col("root").alias("root_a"))
        return met.join(of_pivot, ["often", "list", "a"]).filter("root <> root_a").selectExpr("a", "rep AS b")

    def still_apart(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of keys whose members are in different components so far, with these."""
        root = components(links).withColumnRenamed("node", "rep")
        placed = rows.join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        apart = placed.groupBy("often", "list").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
        return written(placed.join(apart.select("often", "list"), ["often", "list"]))

    links = verified(with_pivots(groups, "-rep", "struct(weight, -rep)"))
    for turn in range(PIVOT_ROUNDS):
        placed = still_apart(groups, links)
        links = written(links.unionByName(verified(with_pivots(placed, f"xxhash64(rep, {2 * turn})", f"xxhash64(rep, {2 * turn + 1})"))))
    # what a key still has in different components is compared pair by pair
    placed = still_apart(groups, links).join(nodes.select(F.col("id").alias("rep"), "n", *FOLD_COLUMNS), "rep").select("often", "list", "rep", "root", "n", "rare", *FOLD_COLUMNS)
    other = placed.selectExpr("often", "list", "rep AS b", "root AS root_b", "n AS nb", "rare AS rare_b", *[f"{c} AS {c}b" for c in FOLD_COLUMNS])
    # no rare token is common to a pair that only frequent keys find: each is in one of the two
    sizes = "100 * least(n, nb) >= 80 * greatest(n, nb) and rare + rare_b <= n + nb - 2 * ceil(4 * (n + nb) / 9)"
    # parities that differ are tokens that only one of the two has: no more than a linked pair may have
    differ = " + ".join(f"bit_count({c} ^ {c}b)" for c in FOLD_COLUMNS)
    pairs = placed.join(other, ["often", "list"]).filter(f"root < root_b and {sizes} and {differ} <= n + nb - 2 * ceil(4 * (n + nb) / 9)")
    links = written(links.unionByName(verified(pairs.selectExpr("rep AS a", "b"))))
    root = components(links)

    named = rep_of.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    out = own.select("id", "n").join(named, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that another row stands for: of each component the row of
    its smallest doc_id stays, of repeated rows with that id one; texts without
    shingles and rows with a null doc_id stay."""
    found = join(docs).filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    gone = written(found.filter("doc_id <> component_id").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    twice = left.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    once = left.join(twice, "doc_id", "left_anti").select(*docs.columns)
    place = free_name(docs.columns, "_place")
    first = left.join(twice, "doc_id", "left_semi").withColumn(place, F.row_number().over(again))
    empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    return once.unionByName(first.filter((F.col(place) == 1) | empty).select(*docs.columns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
root AS (SELECT x, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root ON root.x = d.doc_id
"""
