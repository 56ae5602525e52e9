"""13. Quality: a linear-chain conditional random field over the lines of a text.

Every line that isn't blank is a position of its text's chain and is good or bad.  Its
features are the classes of ``MEASURES`` of its form (share of capitals, symbols, repeated
words, ...) and those of the line before and after it; no word, language or source is known
to the field.  Forward-backward gives each line's marginal, and the marginals weighted by
the lines' lengths give the text's share and amount of bad lines, from which a logistic
link makes the score (probability of label 1).

Labels are of documents, so lines are labelled weakly: all lines of good documents are
good; in bad documents all lines are bad at first, then those that the fitted field takes
for bad (the worst line always), and the field is fitted again, ``RELABEL`` times.  It is
fitted on the driver by gradient ascent, transitions included, on at most ``SAMPLE_DOCS``
labelled texts a class of at most ``SAMPLE_CHARS`` characters.  Scoring covers every line
of every text, whatever its length.

Null, empty and blank texts have no lines; their score is the smoothed share of good ones
among such texts of the sample.  With labels of one class only every score is the share of
good labels (0.5 without any).  Repeated rows are scored each and alike, so ties are
equal scores.  Rows of ``labels`` with nulls are ignored; of several labels for one
document the largest counts.  An empty table gives no rows.  Columns of ``docs`` named like
a result (``score``, ``n_lines``, ``bad_lines``, ``lines``) are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import table

SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
RELABEL = 2
PIECE = 1_000_000  # characters measured at a time

UPPER, LOWER, DIGIT, SPACE, ALPHA, SYMBOL = range(6)
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
# measure of a line -> the edges of its classes
MEASURES = {
    "capitals among letters": SHARES,
    "symbols among characters": SHARES,
    "digits among characters": SHARES,
    "distinct among words": SHARES,
    "words like the one before": SHARES,
    "symbols like the one before, a word": SHARES,
    "words of one character": SHARES,
    "characters a word": (1, 2, 3, 4, 5, 6, 8, 12, 24),
    "words": (1, 2, 4, 8, 16, 32, 64, 256, 1024),
}
CLASSES = 10  # of a measure; one more says that there is no such neighbour


@lru_cache
def kinds() -> np.ndarray:
    """The kind of each character below U+3000; all others count as letters without case."""
    def kind(c: str) -> int:
        if c.isspace():
            return SPACE
        if c.isdigit():
            return DIGIT
        if c.isalpha():
            return UPPER if c.isupper() else LOWER if c.islower() else ALPHA
        return SYMBOL

    return np.array([kind(chr(i)) for i in range(0x3000)] + [ALPHA], np.uint8)


@dataclass
class Lines:
    """The lines of some texts in order: text number, offsets, classes of the measures."""

    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    classes: np.ndarray
    n_docs: int

    @property
    def lengths(self) -> np.ndarray:
        return (self.end - self.begin).astype(float)

    def features(self) -> np.ndarray:
        """3 x lines x measures: own classes, those of the line before and of the line after."""
        n = len(self.doc)
        out = np.full((3, n, len(MEASURES)), CLASSES, np.uint8)
        out[0] = self.classes
        linked = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        out[1, linked], out[2, linked - 1] = self.classes[linked - 1], self.classes[linked]
        return out


def lines_of(texts: list[str | None]) -> Lines:
    """The lines of the texts that aren't blank."""
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[np.minimum(code, 0x3000)]
    line = np.cumsum(code == 10) - (code == 10)  # a line's own newline belongs to it
    ends = np.append(np.flatnonzero(code == 10), len(code))
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    count = np.bincount(line * 6 + kind, minlength=6 * n).reshape(n, 6)
    ink = np.concatenate([[False], kind != SPACE, [False]])
    start = ink[1:-1] & ~ink[:-2]
    words = np.bincount(line[start], minlength=n)
    single = np.bincount(line[start & ~ink[2:]], minlength=n)
    again = (kind[1:] == SYMBOL) & (code[1:] == code[:-1]) if len(code) else np.zeros(0, bool)
    doubled = np.bincount(line[1:][again], minlength=n)
    keep = np.flatnonzero(words)
    distinct, repeated, rows = np.empty(len(keep)), np.empty(len(keep)), joined.split("\n")
    for i, k in enumerate(keep.tolist()):
        w = rows[k].split()
        distinct[i], repeated[i] = len(set(w)), sum(map(eq, w, islice(w, 1, None)))
    count, words = count[keep], words[keep]
    letters = np.maximum(count[:, [UPPER, LOWER, ALPHA]].sum(axis=1), 1)
    full = np.maximum(count.sum(axis=1) - count[:, SPACE], 1)
    measures = [
        count[:, UPPER] / letters, count[:, SYMBOL] / full, count[:, DIGIT] / full, distinct / words, repeated / words,
        doubled[keep] / words, single[keep] / words, full / words, words,
    ]
    classes = np.stack([np.searchsorted(edges, m) for edges, m in zip(MEASURES.values(), measures)], axis=1).astype(np.uint8)
    doc_begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    doc = np.searchsorted(doc_begin, begins[keep], side="right") - 1
    return Lines(doc, begins[keep] - doc_begin[doc], ends[keep] - doc_begin[doc], classes, len(texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward_backward(odds: np.ndarray, pair: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of two-state chains, all chains at once.

    ``odds``: log-odds of state 1 that a position alone gives.  ``pair``: 2 x 2 scores of
    (state before, state).  ``doc`` numbers the chains, positions in order.  Gives the
    log-odds of state 1 per position, and the probabilities (n x 2 x 2) of the states before
    and at each position, 0 at a chain's first.
    """
    n = len(odds)
    firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
    lengths = np.diff(np.append(firsts, n))
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = firsts[order], lengths[order]
    # the positions at each step: those of the chains that reach it
    steps = [firsts[: np.searchsorted(-lengths, -t, side="left")] + t for t in range(int(lengths[0]) if n else 0)]
    forward, backward = odds.copy(), np.zeros(n)
    for at in steps[1:]:
        f = forward[at - 1]
        forward[at] += np.logaddexp(pair[0, 1], f + pair[1, 1]) - np.logaddexp(pair[0, 0], f + pair[1, 0])
    for at in reversed(steps[1:]):
        b = odds[at] + backward[at]
        backward[at - 1] = np.logaddexp(pair[1, 0], b + pair[1, 1]) - np.logaddexp(pair[0, 0], b + pair[0, 1])
    joint = np.zeros((n, 2, 2))
    if len(steps) > 1:
        later = np.concatenate(steps[1:])
        f, b = forward[later - 1], odds[later] + backward[later]
        z = np.stack([np.full(len(later), pair[0, 0]), pair[0, 1] + b, pair[1, 0] + f, pair[1, 1] + f + b], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        joint[later] = (z / z.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
    return forward + backward, joint


@dataclass
class Model:
    """State 1 is bad.  Without a link every text gets ``prior``."""

    weights: np.ndarray  # 3 x measures x classes
    bias: float
    pair: np.ndarray
    link: np.ndarray
    prior: float
    blank: float

    def odds(self, features: np.ndarray) -> np.ndarray:
        out = np.full(features.shape[1], self.bias)
        for k in range(3):
            for m in range(len(MEASURES)):
                out += self.weights[k, m, features[k, :, m]]
        return out

    def marginals(self, lines: Lines) -> np.ndarray:
        """Probability that a line is bad, per line."""
        return sigmoid(forward_backward(self.odds(lines.features()), self.pair, lines.doc)[0])

    def score_lines(self, lines: Lines, bad: np.ndarray) -> np.ndarray:
        """Score per text from its lines' marginals."""
        some = np.bincount(lines.doc, minlength=lines.n_docs) > 0
        return np.where(some, sigmoid(evidence(lines, bad) @ self.link), self.blank)


def evidence(lines: Lines, bad: np.ndarray) -> np.ndarray:
    """Per text: 1, log-odds of the length-weighted mean of the marginals, log of their length-weighted sum."""
    amount = np.bincount(lines.doc, bad * lines.lengths, lines.n_docs)
    share = np.clip(amount / np.maximum(np.bincount(lines.doc, lines.lengths, lines.n_docs), 1), 1e-3, 1 - 1e-3)
    return np.stack([np.ones(lines.n_docs), np.log(share / (1 - share)), np.log1p(amount)], axis=1)


def fit_field(model: Model, lines: Lines, y: np.ndarray, steps: int, rate: float = 0.1, l2: float = 1e-4) -> None:
    """Gradient ascent (Adam) on the likelihood of the lines' states."""
    features, n = lines.features(), max(1, len(y))
    later = np.flatnonzero(np.concatenate([[False], lines.doc[1:] == lines.doc[:-1]]))
    seen = np.bincount(2 * y[later - 1] + y[later], minlength=4).reshape(2, 2)
    size = model.weights.size
    mean, square = np.zeros(size + 5), np.zeros(size + 5)
    index = (np.arange(3)[:, None, None] * len(MEASURES) + np.arange(len(MEASURES))[None, None, :]) * (CLASSES + 1) + features
    for step in range(1, steps + 1):
        odds, joint = forward_backward(model.odds(features), model.pair, lines.doc)
        g = y - sigmoid(odds)
        slots = np.bincount(index.ravel(), np.broadcast_to(g[None, :, None], index.shape).ravel(), size) / n - l2 * model.weights.ravel()
        grad = np.concatenate([slots, [g.sum() / n], ((seen - joint.sum(axis=0)) / n - l2 * model.pair).ravel()])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights + move[:size].reshape(model.weights.shape)
        model.bias += float(move[size])
        model.pair = model.pair + move[size + 1 :].reshape(2, 2)


def fit_link(x: np.ndarray, good: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton steps of a weighted logistic regression; targets a little inside 0 and 1."""
    link, target = np.zeros(x.shape[1]), np.clip(good.astype(float), 0.002, 0.998)
    for _ in range(40):
        p = sigmoid(x @ link)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        link = link + np.linalg.solve(h, x.T @ (weight * (target - p)) - l2 * link)
    return link


def fit(texts: list[str], good: np.ndarray, share: float, relabel: int = RELABEL) -> Model:
    """``good``: 0/1 per text; ``share``: of good ones among all labels."""
    lines = lines_of(texts)
    model = Model(np.zeros((3, len(MEASURES), CLASSES + 1)), 0.0, np.zeros((2, 2)), np.zeros(3), share, share)
    in_bad = good[lines.doc] == 0
    y = in_bad.astype(np.int64)
    fit_field(model, lines, y, 120)
    for _ in range(relabel):
        bad = model.marginals(lines)
        worst = np.zeros(lines.n_docs)
        np.maximum.at(worst, lines.doc, bad)
        y = (in_bad & ((bad >= 0.5) | (bad >= worst[lines.doc]))).astype(np.int64)
        fit_field(model, lines, y, 80)
    # the sample holds as many of each class; weights give back their shares
    weight = np.where(good > 0, share / max(1, (good > 0).sum()), (1 - share) / max(1, (good == 0).sum()))
    some = np.bincount(lines.doc, minlength=lines.n_docs) > 0
    model.link = fit_link(evidence(lines, model.marginals(lines))[some], good[some], weight[some] * len(texts))
    none = weight[~some] * len(texts)
    model.blank = float(((none * good[~some]).sum() + 2 * share) / (none.sum() + 2))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_docs: int, sample_chars: int) -> tuple[list[str], np.ndarray, float]:
    """At most ``sample_docs`` texts of each class, those whose ids hash lowest, and the share of class 1."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y"))
    n, share = rows.agg(F.count("*"), F.avg("_y")).first()
    if not n:
        return [], np.zeros(0, np.int64), 0.5
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    # twice as many ids as texts wanted, as some texts are too long, null or not there
    picked = [rows.filter(F.col("_y") == y).orderBy(*by_hash).limit(2 * sample_docs) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # bounded by the parameter
    found = docs.select("doc_id", "text").join(ids, "doc_id").filter(F.length("text") <= sample_chars)
    texts, good = [], []
    for y in (0, 1):
        got = [r["text"] for r in found.filter(F.col("_y") == y).orderBy(*by_hash, "text").limit(sample_docs).select("text").collect()]
        texts += got
        good += [y] * len(got)
    return texts, np.array(good, np.int64), float(share)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on labelled rows of ``labels`` (doc_id, quality); give only those to learn from."""
    texts, good, share = labelled_sample(docs, labels, "quality", sample_docs, sample_chars)
    if len(set(good.tolist())) < 2:
        return Model(np.zeros((3, len(MEASURES), CLASSES + 1)), 0.0, np.zeros((2, 2)), np.zeros(0), share, share)
    return fit(texts, good, share)


def pieces(texts: list[str | None], limit: int = PIECE) -> Iterator[list[str | None]]:
    """Whole texts in runs of about ``limit`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) if t else 0
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


LINES = "array<struct<begin:int,end:int,good:double>>"


def score(docs: DataFrame, model: Model, with_lines: bool = False) -> DataFrame:
    """docs with ``score``, ``n_lines`` and ``bad_lines`` (likelier bad than good), and if
    wanted ``lines``: offsets and probability of being good of every line."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    kind = "struct<score:double,n_lines:int,bad_lines:int" + (f",lines:{LINES}>" if with_lines else ">")

    def judged(m: Model, texts: list[str | None]) -> pd.DataFrame:
        lines = lines_of(texts)
        bad = m.marginals(lines)
        scores = m.score_lines(lines, bad) if len(m.link) else np.full(len(texts), m.prior)
        n = np.bincount(lines.doc, minlength=len(texts)).astype(np.int32)
        out = {"score": scores, "n_lines": n, "bad_lines": np.bincount(lines.doc, bad > 0.5, len(texts)).astype(np.int32)}
        if with_lines:
            rows = [{"begin": b, "end": e, "good": g} for b, e, g in zip(lines.begin.tolist(), lines.end.tolist(), (1 - bad).tolist())]
            cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
            out["lines"] = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame(out)

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            yield pd.concat([judged(m, run) for run in pieces(texts.tolist())] or [judged(m, [])], ignore_index=True)

    names = ["score", "n_lines", "bad_lines", "lines"][: 3 + with_lines]
    kept = [c for c in docs.columns if c.lower() not in names]
    found = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], scored(F.col("text")).alias("r"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"r.{c}") for c in names])


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"
LEAST = 0.3


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(f"NOT ({HELD_OUT})"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"), "n_lines", "bad_lines"
    )
