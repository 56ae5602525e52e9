"""5. LM scoring: stupid backoff over n-gram count tables partitioned by hash.

Documents are dealt to chunks by hash.  A chunk explodes its documents into n-grams of
all orders and sends each distinct one, by hash, with its count to a partition of the
count table; there the counts of all chunks are summed and joined back to the chunks'
n-grams; the chunk then sums the scores of its documents.  An n-gram travels once per
chunk and way, as differences of sorted 64-bit hashes, and a common n-gram is one row
per chunk, so no key is hot.

A document is scored by the counts of all other documents (its own are taken off):
the score of a word after the two before it is count(uvw) / count(uv) if uvw was
seen, else ``BACKOFF`` times the score after one word, and so on down to
max(count(w), 1/2) / words.  The first words of a document have shorter histories.
``mean_log_score`` is the mean natural logarithm over the words.

Words are ``[^ \\t-\\r]+`` with A-Z lower-cased.  Texts without words and null texts have
n_words 0 and a null score.  Repeated rows are documents of their own.  An empty table
gives no rows.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import HASHES, MIX, mixed, table, words_of

ORDER = 3
BACKOFF = 0.4
CHUNK_WORDS = 3_000_000
BUCKET_KEYS = 2_000_000
#: words of whole documents that are counted off and scored at a time
PART_WORDS = 250_000


def squeezed(numbers: np.ndarray) -> bytes:
    """Integers packed by byte plane, so that high bytes cost nothing."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class ChunkGrams:
    """The n-grams of a chunk's documents, one order at a time to bound memory: ``grams`` gives
    the sorted distinct n-grams of an order, with the places where they end."""

    def __init__(self, texts: list[str | None]):
        hashes = [np.fromiter(map(HASHES.__getitem__, words_of(t)), np.uint64) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.doc = np.repeat(np.arange(len(hashes), dtype=np.int32), self.sizes)
        self.place = np.concatenate([np.empty(0, np.int32), *(np.arange(n, dtype=np.int32) for n in self.sizes.tolist())])

    def parts(self, size: int = PART_WORDS) -> list[slice]:
        """The words in runs of whole documents, of about that many words."""
        ends = np.cumsum(self.sizes)
        cuts = np.unique(ends[np.flatnonzero(np.diff(ends // size, append=-1))]).tolist()
        return [slice(i, j) for i, j in zip([0, *cuts], cuts) if j > i]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, hash) of each n-gram of the order."""
        end = np.flatnonzero(self.place >= order - 1)
        h = np.full(len(end), order, np.uint64)
        for i in range(order):
            h = h * MIX + self.words[end - order + 1 + i]
        return end, mixed(h)

    def others(self, order: int, total: np.ndarray) -> np.ndarray:
        """For each word, how often the n-gram that ends there is in other documents;
        ``total``: by sorted distinct n-gram, how often it is in all."""
        end, h = self.grams(order)
        known, out = np.unique(h), np.zeros(len(self.words), np.int64)
        for part in self.parts():
            k = slice(*np.searchsorted(end, (part.start, part.stop)))
            own_grams, at = np.unique(h[k], return_inverse=True)
            _, inverse, own = np.unique(self.doc[end[k]].astype(np.int64) * len(own_grams) + at, return_inverse=True, return_counts=True)
            out[end[k]] = total[np.searchsorted(known, own_grams)][at] - own[inverse]
        return out


def word_scores(seen: list[np.ndarray], place: np.ndarray, words: np.ndarray, backoff: float) -> np.ndarray:
    """Logarithms; ``words``: for each word how many words the other documents have."""
    out = np.log(np.maximum(seen[0], 0.5) / np.maximum(words, 1))
    for k in range(1, len(seen)):
        before = np.concatenate([[0], seen[k - 1][:-1]])
        got = (seen[k] > 0) & (before > 0)
        longer = np.log(np.where(got, seen[k], 1) / np.where(got, before, 1))
        out = np.where(place >= k, np.where(got, longer, np.log(backoff) + out), out)
    return out


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_words, mean_log_score) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    chunks = max(1, -(-words // chunk_words))
    bits = max(0, int(np.ceil(np.log2(max(1, words / BUCKET_KEYS)))))
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def count(group: pa.Table) -> pa.Table:
        grams, rows = ChunkGrams(group.column("text").to_pylist()), []
        for k in range(1, order + 1):
            known, counts = np.unique(grams.grams(k)[1], return_counts=True)
            cuts = [0, *np.searchsorted(known, borders).tolist(), len(known)]
            rows += [(group.column("chunk")[0].as_py(), (k << 20) + b, squeezed(np.diff(known[i:j], prepend=np.uint64(0))), squeezed(counts[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["chunk", "bucket", "grams", "counts"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(unsqueezed(g, np.uint64), dtype=np.uint64) for g in group.column("grams").to_pylist()]
        counts = np.concatenate([unsqueezed(c, np.uint32) for c in group.column("counts").to_pylist()]).astype(np.int64)
        known, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, inverse, counts)
        ends = np.cumsum([len(p) for p in parts])
        out = [squeezed(total[i].astype(np.uint64)) for i in np.split(inverse, ends[:-1])]
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "counts": pa.array(out, pa.binary())})

    def sum_up(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "mean_log_score": pa.array([], pa.float64())})
        grams, seen = ChunkGrams(left.column("text").to_pylist()), []
        bucket = right.column("bucket").to_numpy() if right.num_rows else np.zeros(0, np.int32)
        for k in range(1, order + 1):
            mine = [i for i in np.argsort(bucket).tolist() if bucket[i] >> 20 == k]
            total = [unsqueezed(right.column("counts")[i].as_py(), np.uint64).astype(np.int64) for i in mine]
            seen.append(grams.others(k, np.concatenate([np.zeros(0, np.int64), *total])))
        sums = np.zeros(len(grams.sizes))
        for k in grams.parts():
            first, last = grams.doc[k.start], grams.doc[k.stop - 1] + 1
            log = word_scores([x[k] for x in seen], grams.place[k], words - grams.sizes[grams.doc[k]], backoff)
            sums[first:last] = np.bincount(grams.doc[k] - first, log, last - first)
        mean = pa.array(sums / np.maximum(grams.sizes, 1), mask=grams.sizes == 0)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(grams.sizes), "mean_log_score": mean})

    grams = dealt.groupBy("chunk").applyInArrow(count, "chunk long, bucket int, grams binary, counts binary")
    totals = grams.groupBy("bucket").applyInArrow(add, "chunk long, bucket int, counts binary")
    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(sum_up, "doc_id long, n_words long, mean_log_score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"))
    return out.withColumn("mean_log_score", F.round("mean_log_score", 6))


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
n AS (SELECT doc_id, coalesce(len(ws), 0) AS n_words FROM d),
total AS (SELECT sum(n_words) AS words FROM n),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM d WHERE len(ws) > 0),
g AS (SELECT doc_id, i, ws[i] AS g1,
        CASE WHEN i >= 2 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
        CASE WHEN i >= 3 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3
      FROM pos),
o1 AS (SELECT doc_id, g1, count(*) AS own, sum(count(*)) OVER (PARTITION BY g1) AS seen FROM g GROUP BY doc_id, g1),
o2 AS (SELECT doc_id, g2, count(*) AS own, sum(count(*)) OVER (PARTITION BY g2) AS seen FROM g WHERE i >= 2 GROUP BY doc_id, g2),
o3 AS (SELECT doc_id, g3, count(*) AS own, sum(count(*)) OVER (PARTITION BY g3) AS seen FROM g WHERE i >= 3 GROUP BY doc_id, g3),
c AS (SELECT g.doc_id, g.i, o1.seen - o1.own AS c1, o2.seen - o2.own AS c2, o3.seen - o3.own AS c3
      FROM g JOIN o1 USING (doc_id, g1) LEFT JOIN o2 USING (doc_id, g2) LEFT JOIN o3 USING (doc_id, g3)),
h AS (SELECT *, lag(c1) OVER w AS h1, lag(c2) OVER w AS h2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s1 AS (SELECT h.*, ln(greatest(c1, 0.5) / greatest(words - n_words, 1)) AS l1 FROM h JOIN n USING (doc_id), total),
s2 AS (SELECT *, CASE WHEN i < 2 THEN l1 WHEN c2 > 0 AND h1 > 0 THEN ln(c2 / h1) ELSE ln(0.4) + l1 END AS l2 FROM s1),
s3 AS (SELECT *, CASE WHEN i < 3 THEN l2 WHEN c3 > 0 AND h2 > 0 THEN ln(c3 / h2) ELSE ln(0.4) + l2 END AS l3 FROM s2)
SELECT n.doc_id, n.n_words::BIGINT AS n_words, round(avg(l3), 6) AS mean_log_score
FROM n LEFT JOIN s3 USING (doc_id) GROUP BY n.doc_id, n.n_words
"""
