"""1. Toxicity: a linear-chain conditional random field over the words of a sentence.

Words of labelled documents get token labels: in a document labelled toxic a word is
toxic if its form or its stem is far commoner in toxic than in other documents of the
sample; all other words are clean.  The field has two states, word and stem features
of the sample, and transition scores, all fitted by gradient ascent on the driver from a
sample of at most ``SAMPLE_DOCS`` labelled documents of a class, each of at most
``SAMPLE_CHARS`` characters; that sample is the only bounded thing here.  Scoring covers
every word of every text: forward-backward marginals per word, summed and maximised per
document, and a logistic link fitted on the same sample gives the score.  The runs of words
whose marginal is a half or more are the offending spans, as character offsets of the text.

Null and empty texts have no words; their score is the link's value at no evidence, and
they have no spans.  Very long texts are scored whole.  Equal texts have equal scores.
Without labels of both classes every score is the share of toxic labels (0 without
any).  Repeated rows are scored each; rows of ``labels`` with nulls are ignored, of
several labels for one document the largest counts.  Columns of the documents that are
called ``score`` or ``spans`` are replaced by the results, others stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import table

SAMPLE_DOCS = 1200
SAMPLE_CHARS = 20_000
STEM = 5
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


class WordFeatures(dict):
    """word -> the numbers of its word and its stem among the known features (0: not known).

    Words are remembered for up to ``size`` entries."""

    def __init__(self, known: dict[str, int], size: int = 300_000):
        super().__init__()
        self.known, self.size = known, size

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= self.size:
            self.clear()
        self[word] = f = (self.known.get("w" + word, 0), self.known.get("p" + word[:STEM], 0))
        return f

    def __reduce__(self):
        return WordFeatures, (self.known, self.size)


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words by sentence."""
    return [w for s in SENTENCE.split(text.lower()) if (w := WORD.findall(s))] if text else []


@dataclass
class Chains:
    """Sentences laid out for vectorised passes: all that reach position t, longest first."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(-self.lengths, kind="stable")
        ordered = self.lengths[self.order]
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1][self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        # how many sentences have a word at each position
        self.active = np.searchsorted(-ordered, -np.arange(steps), side="left")

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log-odds of state 1 per word given the sentence.

        ``unary``: log-odds that a word alone gives.  ``pair``: 2 x 2 transition scores.
        """
        forward, backward = self.passes(unary, pair)
        return forward + backward

    def transitions(self, unary: np.ndarray, pair: np.ndarray, passes: tuple[np.ndarray, np.ndarray], later: np.ndarray) -> np.ndarray:
        """Expected number of transitions (state before, state) at the words ``later``."""
        forward, backward = passes
        f, b = forward[later - 1], unary[later] + backward[later]
        z = np.stack([np.full(len(later), pair[0, 0]), pair[0, 1] + b, pair[1, 0] + f, pair[1, 1] + f + b], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return (z / z.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)

    def passes(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward log-odds (the word's own included) and backward log-odds."""
        carry = lambda x: np.logaddexp(x + pair[1, 1], pair[0, 1]) - np.logaddexp(x + pair[1, 0], pair[0, 0])
        carry_back = lambda x: np.logaddexp(x + pair[1, 1], pair[1, 0]) - np.logaddexp(x + pair[0, 1], pair[0, 0])
        forward, backward = unary.copy(), np.zeros_like(unary)
        for t in range(1, len(self.active)):
            at = self.first[: self.active[t]] + t
            forward[at] += carry(forward[at - 1])
        for t in range(len(self.active) - 1, 0, -1):
            at = self.first[: self.active[t]] + t
            backward[at - 1] = carry_back(unary[at] + backward[at])
        return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    features: WordFeatures
    weights: np.ndarray
    pair: np.ndarray
    link: np.ndarray
    prior: float

    def unary(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[-1] + self.weights[slots].sum(axis=1)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Marginal log-odds of all words of the texts in order; words per text."""
        parts = [sentences(t) for t in texts]
        lengths = np.array([len(s) for p in parts for s in p], np.int64)
        counts = np.array([sum(map(len, p)) for p in parts], np.int64)
        odds = Chains(lengths).marginals(self.unary(self.slots(parts, int(lengths.sum()))), self.pair)
        return odds, counts, parts

    def slots(self, parts: list[list[list[str]]], n: int) -> np.ndarray:
        return np.fromiter((i for p in parts for s in p for i in map(self.features.__getitem__, s)), np.dtype((np.int32, 2)), n)

    def evidence(self, odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per document: 1, the largest marginal (log-odds, bounded), log of 1 + summed marginals."""
        out = np.zeros((len(counts), 3))
        out[:, 0], out[:, 1] = 1, -10
        if len(odds):
            doc = np.repeat(np.arange(len(counts)), counts)
            np.maximum.at(out[:, 1], doc, np.clip(odds, -10, 10))
            out[:, 2] = np.log1p(np.bincount(doc, sigmoid(odds), len(counts)))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.judged(texts, False)[0]

    def judged(self, texts: list[str | None], with_spans: bool) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores and, if wanted, spans of the texts, from the same marginals."""
        if not len(self.link):
            return np.full(len(texts), self.prior), [[] for _ in texts]
        odds, counts, _ = self.words(texts)
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if with_spans and len(odds):
            ends = np.cumsum(counts)
            hit = np.unique(np.searchsorted(ends, np.flatnonzero(odds >= 0), side="right"))
            for i in hit.tolist():  # texts with a toxic word
                found[i] = self.runs(texts[i], odds[ends[i] - counts[i] : ends[i]])
        return sigmoid(self.evidence(odds, counts) @ self.link), found

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        return self.judged([text], True)[1][0]

    @staticmethod
    def runs(text: str, odds: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """(begin, end, probability) of each run of toxic words, as character offsets."""
        low, out, k = text.lower(), [], 0
        for s, e in [(m.start(), m.end()) for m in re.finditer(r"[^.!?\n]+", low)]:
            run = None
            for m in WORD.finditer(low, s, e):
                p = float(sigmoid(odds[k : k + 1])[0])
                k += 1
                if p >= threshold:
                    run = (run[0], m.end(), max(run[2], p)) if run else (m.start(), m.end(), p)
                elif run:
                    out.append(run)
                    run = None
            if run:
                out.append(run)
        if len(low) != len(text):  # lower-casing made letters longer: back to the text's own offsets
            own = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
            out = [(int(own[b]), int(own[e - 1]) + 1, p) for b, e, p in out]
        return out


def token_labels(parts: list[list[list[str]]], toxic: np.ndarray, odds: float = 2.5, chance: float = 0.02) -> tuple[np.ndarray, dict[str, int]]:
    """0/1 per word, and the number of sentences per feature.  1: in toxic documents, words whose form or stem marks toxic documents.

    Counted are distinct sentences, as copies of one document say nothing new.  A mark's
    smoothed log-odds are ``odds`` at least, and its log-likelihood ratio (twice the gain over
    the sample's share) is so large that about ``chance`` of all the sample's forms and stems
    would reach it by chance: one test for samples of every size."""
    counts: dict[str, list[int]] = {}
    distinct = {(int(y), tuple(s)) for p, y in zip(parts, toxic) for s in p}
    for y, words in distinct:
        for k in {k for w in words for k in ("w" + w, "p" + w[:STEM])}:
            counts.setdefault(k, [0, 0])[y] += 1
    total = np.maximum(np.bincount([y for y, _ in distinct], minlength=2), 1)
    base, least = total / total.sum(), 2 * np.log(max(1, len(counts)) / chance)

    def is_mark(c: int, t: int) -> bool:
        if np.log((t + 0.5) / total[1]) - np.log((c + 0.5) / total[0]) < odds:
            return False
        n = c + t  # log-likelihood ratio against the sample's share of toxic sentences
        return 2 * sum(x * np.log(x / (n * p)) for x, p in ((c, base[0]), (t, base[1])) if x) >= least

    marks = {k for k, (c, t) in counts.items() if is_mark(c, t)}
    hit = lambda w: "w" + w in marks or (len(w) >= STEM and "p" + w[:STEM] in marks)
    labels = np.fromiter((y and hit(w) for p, y in zip(parts, toxic) for s in p for w in s), float)
    return labels, {k: c + t for k, (c, t) in counts.items()}


def fit(texts: list[str], toxic: np.ndarray, prior: float, steps: int = 40, rate: float = 1.0, l2: float = 1e-6) -> Model:
    """Gradient ascent (Adagrad) on the field's likelihood, then the documents' link."""
    parts = [sentences(t) for t in texts]
    y, seen_in = token_labels(parts, toxic)
    features = WordFeatures({f: i for i, f in enumerate((f for f, n in seen_in.items() if n >= 3), 1)})
    model = Model(features, np.zeros(len(features.known) + 2), np.zeros((2, 2)), np.zeros(3), prior)
    lengths = np.array([len(s) for p in parts for s in p], np.int64)
    counts = np.array([sum(map(len, p)) for p in parts], np.int64)
    slots = model.slots(parts, int(lengths.sum()))
    chains, n = Chains(lengths), max(1, len(y))
    starts = np.zeros(len(y), bool)
    starts[np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]] = True
    later = np.flatnonzero(~starts)
    a, b = y[later - 1].astype(int), y[later].astype(int)
    seen = np.bincount(2 * a + b, minlength=4).reshape(2, 2)
    # rare state: its words weigh as much as the others
    weight = np.where(y > 0, min(3.0, n / max(1.0, y.sum()) / 2), 1.0)
    model.pair = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    model.weights[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    total, total_pair = np.full_like(model.weights, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        unary = model.unary(slots)
        passes = chains.passes(unary, model.pair)
        expected = chains.transitions(unary, model.pair, passes, later)
        g = weight * (y - sigmoid(passes[0] + passes[1]))
        grad = np.bincount(slots.ravel(), np.repeat(g, 2), len(model.weights)) / n - l2 * model.weights
        grad[0], grad[-1] = 0, g.sum() / n  # what is not known has no weight
        total += grad**2
        model.weights += rate * grad / np.sqrt(total)
        grad_pair = (seen - expected) / n - l2 * model.pair
        total_pair += grad_pair**2
        model.pair = model.pair + 0.1 * rate * grad_pair / np.sqrt(total_pair)
    odds = chains.marginals(model.unary(slots), model.pair)
    x, target = model.evidence(odds, counts), np.clip(toxic.astype(float), 0.002, 0.998)
    for _ in range(30):  # Newton steps, both classes of equal weight
        p = sigmoid(x @ model.link)
        w = np.where(toxic > 0, 0.5 / max(1, (toxic > 0).sum()), 0.5 / max(1, (toxic == 0).sum()))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(3)
        model.link = model.link + np.linalg.solve(h, x.T @ (w * (target - p)) - 1e-4 * model.link)
    return model


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_chars: int) -> tuple[list[str], np.ndarray, float]:
    """At most ``sample_docs`` texts of each class, those whose ids hash lowest."""
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, share = rows.agg(F.count("*"), F.avg((F.col("toxic") > 0).cast("double"))).first()
    if not n:
        return [], np.zeros(0), 0.0
    # twice as many ids as texts wanted, as some texts are too long, null or not there
    picked = [rows.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs) for c in ("toxic > 0", "toxic <= 0")]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # bounded by the parameter
    found = docs.select("doc_id", "text").join(ids, "doc_id").filter(F.length("text") <= sample_chars)
    texts, toxic = [], []
    for c, y in (("toxic > 0", 1), ("toxic <= 0", 0)):
        got = [r["text"] for r in found.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs).select("text").collect()]
        texts += got
        toxic += [y] * len(got)
    return texts, np.array(toxic), float(share)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on labelled rows of ``labels`` (doc_id, toxic); give only those to learn from."""
    texts, toxic, share = sample(docs, labels, sample_docs, sample_chars)
    if len(set(toxic.tolist())) < 2:
        return Model(WordFeatures({}), np.zeros(0), np.zeros((2, 2)), np.zeros(0), share)
    return fit(texts, toxic, share)


SPANS = "array<struct<begin:int,end:int,probability:double>>"


PIECE = 1_000_000  # characters scored at a time


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


def scored_by(docs: DataFrame, model: Model, with_spans: bool = False) -> Column:
    """The struct of a row's score, and if wanted spans, from its text."""
    # the model's size is bounded by the sample's
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"struct<score:double,spans:{SPANS}>" if with_spans else "struct<score:double>"

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            texts = texts.tolist()
            judged = [m.judged(run, with_spans) for run in pieces(texts)]
            out = pd.DataFrame({"score": np.concatenate([np.zeros(0), *(s for s, _ in judged)])})
            if with_spans:
                out["spans"] = [[{"begin": b, "end": e, "probability": p} for b, e, p in runs] for _, found in judged for runs in found]
            yield out

    return scored(F.col("text"))


def score(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """All columns of docs, ``score``, and if wanted ``spans``: the offending words' offsets.
    Columns of docs with these names are replaced."""
    names = ("score", "spans")[: 1 + with_spans]
    kept = [c for c in docs.columns if c.lower() not in names]
    found = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], scored_by(docs, model, with_spans).alias("r"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"r.{c}").alias(c) for c in names])


def keep_below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs that score below ``limit``, with docs' columns.  A row waits for its
    score with its text once."""
    found = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], scored_by(docs, model).alias("r"))
    return found.filter(F.col("r.score") < limit).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(f"NOT ({HELD_OUT})"))
    found = score(docs.select("doc_id", "text"), model, with_spans=True)
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
