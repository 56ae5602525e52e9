"""7. BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique, so it is enough
to store that token for each prefix: of the vocabulary's tokens that end there (found
with one automaton over all suffixes), the one that is compatible with the token
stored for the prefix before it.  Back-pointers from the end give the ids.  Two tokens
are compatible if no merge across their border comes before the merges that make them.

Texts are normalised, cut and decoded as the tokenizer file says (NFC, lower case,
white space dropped, word ends); special tokens are matched in the raw text.  Null and
empty texts have no ids.  Each row is encoded on its own, with words remembered by the
worker; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import table

END = "\0"  # stands for the mark of a word's end


def byte_letters() -> list[str]:
    """The printable letter for each byte that byte-level vocabularies use."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file with word ends."""

    def __init__(self, tokenizer_file: str, remembered: int = 600_000):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.remembered = spec["model"], remembered
        self.mark = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.vocab = {self._inner(t): i for t, i in model["vocab"].items()}
        self.texts = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self._inner(a), self._inner(b)): r for r, (a, b) in enumerate(merges)}
        self.made = {a + b: (a, b) for a, b in self.rank}
        self.suffixes = ahocorasick.Automaton()
        for t in self.vocab:
            self.suffixes.add_word(t, t)
        self.suffixes.make_automaton()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split, regex.V0)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[str, str, int]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _inner(self, token: str) -> str:
        return token.removesuffix(self.mark) + END if token.endswith(self.mark) and token != self.mark else token

    @lru_cache(maxsize=120_000)  # noqa: B019  two for each token of the vocabulary
    def _edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The tokens at one end of ``token`` while it is built, the last first, each
        with the rank of the merge that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until = self.rank[self.made[token]]
            token = self.made[token][right]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` side by side are encoded as just these two."""
        if (left, right) not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            crossing = ((self.rank.get((a, b)), end_a, end_b) for a, end_a in self._edge(left, True) for b, end_b in self._edge(right, False))
            # at the same rank the merge further left goes first
            self.fits[left, right] = not any(r is not None and r < end_a and r <= end_b for r, end_a, end_b in crossing)
        return self.fits[left, right]

    def encode_word(self, word: str) -> list[int]:
        """ids of one pre-token."""
        if word.isascii() and word.isprintable() and " " not in word:  # letters that stand for themselves
            s = word + END
        else:
            s = "".join(self.letters[b] for b in word.encode("utf-8", "surrogatepass")) + END
        last: list[str | None] = [None] * (len(s) + 1)
        # a one-letter prefix with the end mark is one symbol, so no token ends just before the mark
        for end, token in self.suffixes.iter(s):
            if last[end + 1] is None:
                start = end + 1 - len(token)
                before = last[start]
                if start == 0 or (before is not None and (self.compatible(before, token) if (fit := self.fits.get((before, token))) is None else fit)):
                    last[end + 1] = token
        ids, at = [], len(s)
        while at:
            ids.append(self.vocab[last[at]])
            at -= len(last[at])
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: token texts joined by blanks."""
        return " ".join(self.texts[i] for i in ids)

    def _part(self, part: str) -> tuple[str, str, int]:
        """(decimal ids, decoded text, number of ids) of a run without blanks and line ends."""
        ids: list[int] = []
        for run in self.special_at.split(part):
            if run in self.special:
                ids.append(self.special[run])
            elif run:
                flat = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
                for w in self.words.findall(flat):
                    ids += self.encode_word(w)
        return " ".join(map(str, ids)), self.decode(ids), len(ids)

    def texts_of(self, texts: list[str | None]) -> list[tuple[list[str], list[str], int]]:
        """For each text the runs' decimal ids and decoded texts, and the number of ids."""
        cuts = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        for part in set().union(*cuts).difference(self.known):
            self.known[part] = self._part(part)
        out = []
        for c in cuts:
            got = [x for x in map(self.known.__getitem__, c) if x[2]]
            out.append(([x[0] for x in got], [x[1] for x in got], sum(x[2] for x in got)))
        return out


@lru_cache(maxsize=2)
def word_bpe(tokenizer_file: str) -> WordBpe:
    return WordBpe(tokenizer_file)


def encode_and_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""

    def run(batches):
        bpe = word_bpe(tokenizer_file)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for i in range(0, len(doc_ids), 500):
                got = bpe.texts_of(texts[i : i + 500].to_pylist())
                sha = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
                yield pa.RecordBatch.from_arrays([doc_ids[i : i + 500], pa.array(np.array([n for *_, n in got], np.int64)), pa.array([sha(x) for x, _, _ in got]), pa.array([sha(x) for _, x, _ in got])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
