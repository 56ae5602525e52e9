"""4. Packing: cutting stock by column generation.

Each document's ids are cut into pieces of the sequence length and one remainder.
Piece lengths, rounded up to units, form a histogram of bounded size; a linear
program over patterns (how many pieces of each class share a sequence) is solved by
column generation on the driver, a knapsack dynamic program pricing the columns.
Patterns are rounded down, what is left is filled greedily, and the pieces of a
class, ranked on Spark, take the slots of the patterns in order.

Null and empty texts have the end id only.  Repeated rows are documents of their own.
A null ``doc_id`` is kept.  An empty table gives no rows.  Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.llm.common import table, written
from churnlab.llm.pieces import piece_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each run of up to ``capacity`` ids of each document."""

    def pieces(batches):
        encoder, end = piece_ids(tokenizer_file), struct.pack("<I", end_id)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(doc_ids), 500):
                rows = []
                for doc_id, body in zip(doc_ids[i : i + 500], encoder.encode(texts[i : i + 500].to_pylist())):
                    ids = body + end
                    n = len(ids) // 4
                    rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern and its value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        best[room] = best[room - 1]
        if len(fits):
            got = best[room - sizes[fits]] + value[fits]
            k = int(got.argmax())
            if got[k] > best[room]:
                best[room], last[room] = got[k], fits[k]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each; every
    intermediate basis is feasible, so ``max_columns`` bounds work, not validity."""
    basis = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(max_columns):
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        gain, pattern = best_pattern(price, sizes, capacity)
        if gain <= 1 + 1e-9:
            break
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * way
        x[out] = step
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
    return basis.T.astype(np.int64), np.maximum(x, 0)


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that hold exactly ``demand`` pieces of each size."""
    left, plan = demand.astype(np.int64).copy(), []
    if not len(sizes):
        return plan

    def take(times: int, pattern: np.ndarray) -> None:
        nonlocal left
        if times > 0:
            plan.append((int(times), pattern.copy()))
            left = left - times * pattern

    patterns, x = column_generation(sizes, demand.astype(float), capacity)
    for p in np.argsort(-x):
        used = patterns[p] > 0
        take(min(int(x[p] + 1e-7), int((left[used] // patterns[p][used]).min())), patterns[p])
    while left.any():  # what rounding left: the largest that fits, again and again
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in np.argsort(-sizes):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        used = pattern > 0
        take(int((left[used] // pattern[used]).min()), pattern)
    return plan


def slots(sizes: np.ndarray, plan: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """By size: rows (first rank, first sequence, slots a sequence, first slot) in rank order."""
    rank, sequence, out = dict.fromkeys(sizes.tolist(), 0), 0, {s: [] for s in sizes.tolist()}
    for times, pattern in plan:
        slot = 0
        for i in np.flatnonzero(pattern).tolist():
            s, k = int(sizes[i]), int(pattern[i])
            out[s].append((rank[s], sequence, k, slot))
            rank[s] += times * k
            slot += k
        sequence += times
    return {s: np.array(v, np.int64).reshape(-1, 4) for s, v in out.items()}


def ranked(pieces: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """Adds ``rank``, from 0 within each size class: rows are counted by class and
    hashed chunk first, so that no class, however common, is sorted in one task."""
    total = pieces.count()
    chunks = max(64, -(-total // chunk_rows))
    rows = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("size", "chunk").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("size", "chunk").orderBy("doc_id", "start", "ids_crc32")
    return rows.join(counts, ["size", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("chunk", "base")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 2048, unit: int = 8) -> DataFrame:
    """The pieces with sequence_id, offset in it, and sequence_tokens."""
    pieces = written(cut_pieces(docs, tokenizer_file, end_id, capacity).withColumn("size", F.ceil(F.col("length") / unit).cast("int")))
    # at most capacity / unit rows, whatever the input
    histogram = sorted((r["size"], r["count"]) for r in pieces.groupBy("size").count().collect())
    sizes, demand = np.array([s for s, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    where = slots(sizes, plan_sequences(sizes, demand, capacity // unit))

    def place(batches):
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                mine, rows = size == s, where[s]
                r = rank[mine]
                row = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                sequence[mine] = row[:, 1] + (r - row[:, 0]) // row[:, 2]
                slot[mine] = row[:, 3] + (r - row[:, 0]) % row[:, 2]
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked(pieces).mapInArrow(place, f"{PIECES}, sequence_id long, slot long")
    # a sequence has at most capacity / unit pieces
    inside = Window.partitionBy("sequence_id")
    before = inside.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), F.sum("length").over(inside).alias("sequence_tokens"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
