"""11. Vector code compression: product codes by active-entry Lloyd rounds on integers.

A vector's components become integers, floor(scale * x), and the vector is cut into equal
parts.  Each part position has a codebook, which begins as that part of the vectors with
the smallest keys.  A round assigns every part to the nearest entry of its codebook and
then moves each entry to the componentwise floor of its parts' mean.  The state of a part,
its entry and the exact distance to it, is kept beside the vector.  In the next round a
part whose entry did not move compares only the entries that did with its stored distance;
a part whose entry moved scans its whole codebook.  Of equally near entries the one with
the lower index is taken, in both cases.

One pass over the table a round: the tasks write the new state and, as a last row, their
sums and counts by entry, which Spark adds up.  Only the codebooks (parts x entries x
width integers) reach the driver.  The last two states are kept on disk, older ones go.

Vectors that are null or hold null or non-finite components take no part, nor do those
that can't be cut like the vector with the smallest key: of another length, of a length
that isn't a multiple of the parts (then none takes part), or with a component whose
integer is beyond 2^53.  A null key is after all others; rows that share a key are each
encoded, ordered by their vectors.  Fewer vectors than entries give a smaller codebook, an
empty table no rows.  Other columns are ignored.  Where a squared distance doesn't fit in
a long, comparisons are made in unbounded integers and ``error`` is null if it doesn't fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import removed, table, written, written_at

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2**53
# a label with at least this share of the rows has its sum broadcast: at most 1/share labels
HEAVY_SHARE = 0.001


@dataclass
class Codes:
    """``rows``: key, label, code (array of entry numbers in part order), error.
    ``books``: parts x entries x width.  ``compared``: distances computed, by pass."""

    rows: DataFrame
    books: np.ndarray
    n_rows: int
    compared: list[int] = field(default_factory=list)


def as_integers(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(k, label, v): v holds the integers of the usable vectors."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(label).alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) <= F.lit(float(LARGEST))))
    return rows.filter(fits).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))


def first_vectors(rows: DataFrame, entries: int) -> tuple[np.ndarray, int]:
    """The vectors of the smallest keys that are as long as the very first, and that length."""
    smallest = lambda df: [r["v"] for r in df.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    found = smallest(rows)
    width = len(found[0]) if found else 0
    if any(len(v) != width for v in found):
        found = smallest(rows.filter(F.size("v") == width))
    return np.array(found, np.int64).reshape(len(found), width), width


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x (n x w) to the entries of book (e x w)."""
    out = np.empty((len(x), len(book)), x.dtype)
    for e, entry in enumerate(book):
        d = x - entry
        out[:, e] = (d * d).sum(axis=1)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each row; of equally near entries the lowest."""
    d = squared(x, book)
    entry = d.argmin(axis=1)
    return entry, d[np.arange(len(x)), entry]


def reassigned(x: np.ndarray, entry: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entries and distances under ``book`` given those under the book before, from which
    only the entries ``moved`` differ.  The third value counts the distances computed."""
    entry, dist, n = entry.copy(), dist.copy(), 0
    active = np.flatnonzero(moved)
    if not len(active):
        return entry, dist, 0
    anew = moved[entry]
    rescan = np.flatnonzero(anew)
    if len(rescan):
        entry[rescan], dist[rescan] = nearest(x[rescan], book)
        n += len(rescan) * len(book)
    stay = np.flatnonzero(~anew)
    if len(stay):
        best, d = nearest(x[stay], book[active])
        best = active[best]
        closer = (d < dist[stay]) | ((d == dist[stay]) & (best < entry[stay]))
        entry[stay[closer]], dist[stay[closer]] = best[closer], d[closer]
        n += len(stay) * len(active)
    return entry, dist, n


def passes(books: np.ndarray, moved: np.ndarray | None, last: bool):
    """The function of one pass over the table.  Without ``moved`` all parts are scanned."""
    parts, entries, width = books.shape
    # differences of two integers up to this are squared and summed over a vector in a long
    small = int(np.sqrt(2.0**62 / (4 * parts * width)))
    books_small = not books.size or int(np.abs(books).max()) <= small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, width), object)
        counts, compared = np.zeros((parts, entries), np.int64), 0
        label_type = pa.null()
        for batch in batches:
            label_type = batch.schema.field("label").type
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                n = piece.num_rows
                x = piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
                exact = books_small and (not x.size or int(np.abs(x).max()) <= small)
                y, book = (x, books) if exact else (x.astype(object), books.astype(object))
                code, dist = np.empty((n, parts), np.uint8), np.empty((n, parts), y.dtype)
                if moved is not None:
                    before = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    held = piece.column("dist").flatten().to_numpy(zero_copy_only=False).reshape(n, parts)
                for p in range(parts):
                    # a negative stored distance says that it didn't fit
                    if moved is None or not exact or (held[:, p] < 0).any():
                        entry, dist[:, p] = nearest(y[:, p], book[p])
                        compared += n * entries
                    else:
                        entry, dist[:, p], k = reassigned(y[:, p], before[:, p].astype(np.int64), held[:, p], book[p], moved[p])
                        compared += k
                    code[:, p] = entry
                    counts[p] += np.bincount(entry, minlength=entries)
                    for j in range(width):
                        if exact:  # a sum over 4096 rows is exact in a double
                            totals[p, :, j] += np.bincount(entry, x[:, p, j], entries).astype(np.int64)
                        else:
                            np.add.at(totals[p, :, j], entry, y[:, p, j])
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                if last:
                    error = [int(e) if e < 2**63 else None for e in dist.sum(axis=1)]
                    yield pa.RecordBatch.from_arrays([piece.column("k"), piece.column("label"), codes, pa.array(error, pa.int64())], ["k", "label", "code", "error"])
                    continue
                stored = dist if exact else np.full(dist.shape, -1)
                offsets = np.arange(0, n * parts + 1, parts, dtype=np.int32)
                dists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(stored.astype(np.int64).ravel()))
                none = [pa.nulls(n, t) for t in SUMS]
                yield pa.RecordBatch.from_arrays([piece.column("k"), piece.column("label"), piece.column("v"), codes, dists, *none], NAMES)
        if not last and counts.any():
            m = parts * entries
            sums = [[Decimal(int(s)) for s in row] for row in totals.reshape(m, width)]
            own = [pa.array(np.arange(m, dtype=np.int32)), pa.array(counts.ravel()), pa.array(sums, SUMS[2]), pa.array([compared] + [0] * (m - 1), pa.int64())]
            empty = [pa.nulls(m, t) for t in (pa.int64(), label_type, pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, *own], NAMES)

    return run


NAMES = ["k", "label", "v", "code", "dist", "slot", "n", "total", "compared"]
SUMS = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.int64()]


def moved_books(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The codebooks at the floor of their parts' means, the vectors counted and the distances computed."""
    parts, entries, width = books.shape
    sums = state.filter("slot is not null").groupBy("slot").agg(
        F.sum("n").alias("n"), F.sum("compared").alias("compared"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)]
    )
    new, rows, compared = books.copy(), 0, 0
    for r in sums.collect():  # parts x entries rows
        p, e = divmod(r["slot"], entries)
        compared += r["compared"]
        rows += r["n"] if p == 0 else 0
        if r["n"]:
            new[p, e] = [int(r[f"t{j}"]) // r["n"] for j in range(width)]
    return new, rows, compared


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """Codes of all usable rows of ``vectors`` and the codebooks after ``rounds`` rounds."""
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte: 1 to 256 entries")
    rows = as_integers(vectors, key, vector, label, scale)
    first, width = first_vectors(rows, entries)
    kind = rows.schema["label"].dataType.simpleString()
    coded = f"k long, label {kind}, code binary, error long"
    if not len(first) or width % parts:
        return Codes(spark.createDataFrame([], coded), np.zeros((parts, 0, 0), np.int64), 0)
    rows = rows.filter(F.size("v") == width)
    books = first.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    state_schema = f"k long, label {kind}, v array<long>, code binary, dist array<long>, slot int, n long, total array<decimal(38,0)>, compared long"
    out, moved, state, path = Codes(rows, books, 0), None, rows, None
    for _ in range(rounds):
        state, new_path = written_at(state.mapInArrow(passes(books, moved, False), state_schema))
        if path:
            removed(spark, path)
        path = new_path
        new, out.n_rows, n = moved_books(state, books)
        out.compared.append(n)
        moved, books = (new != books).any(axis=2), new
        state = state.filter("slot is null").select("k", "label", "v", "code", "dist")
    out.rows = written(state.mapInArrow(passes(books, moved, True), coded))
    if path:
        removed(spark, path)
    out.books = books
    return out


def with_label_error(codes: Codes) -> DataFrame:
    """The rows with ``label_error``: the errors summed over the rows of the same label, null
    labels being one.  The sums of labels with many rows (at most 1 / HEAVY_SHARE of them) are
    broadcast; the other labels, none of which is large, are joined by a shuffle."""
    rows = codes.rows
    sums = rows.groupBy("label").agg(F.count("*").alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    heavy = F.broadcast(sums.filter(F.col("_n") >= F.lit(HEAVY_SHARE * codes.n_rows)))
    light = sums.filter(F.col("_n") < F.lit(HEAVY_SHARE * codes.n_rows))
    same = F.col("label").eqNullSafe(F.col("_label"))
    large = rows.join(heavy, same)
    return large.unionByName(rows.join(heavy, same, "left_anti").join(light, same)).drop("_label", "_n")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select(
        F.col("k").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(codes.books)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """The rounds written out: each assigns by the smallest (distance, entry) and takes floors of means."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cells AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // {PARTS}) AS p, (i - 1) % (len(v) // {PARTS}) AS j, v[i] AS x
    FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM kept))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x FROM cells WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(
            f"""near{k} AS MATERIALIZED (SELECT r, p, min(d * {ENTRIES} + e) AS best FROM (
    SELECT c.r, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM cells c JOIN book{k} b ON c.p = b.p AND c.j = b.j GROUP BY ALL) GROUP BY r, p)"""
        )
        if k < ROUNDS:
            ctes.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT c.p, best % {ENTRIES} AS e, j, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM cells c JOIN near{k} n ON c.r = n.r AND c.p = n.p GROUP BY ALL) m ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""
            )
    last = f"near{ROUNDS}"
    ctes.append(
        f"""coded AS (SELECT r, string_agg(lpad(lower(to_hex(best % {ENTRIES})), 2, '0'), '' ORDER BY p) AS code,
    CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM {last} GROUP BY r)"""
    )
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


ORACLE_SQL = _oracle()
