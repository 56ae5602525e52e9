"""The piece encoder of ops 4 and 6 against the whole tokenizers library."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from churnlab.llm import pieces

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["Word", "été", "ǅ", "Жук", "ﬁ", "漢字", "ª", "é", "٣", "42", "½", "_", "'s", "'", ".", "###", "!'ll", "<|endoftext|>", "<|", "|>", "😀", " ", "  ", "\n", "\n\n", "\t", "\r", " ", " ", "\x00"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_text_has_the_library_s_ids(library):
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(PARTS, repeat=n)]
    rng = random.Random(5)
    texts += ["".join(rng.choices(PARTS, k=rng.randrange(4, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choices(["a", "Hello,", "naïve.", "x!!", "12;", "it's", "\nLine", "über###"], k=40)).replace(" \n", "\n") for _ in range(200)]
    encoder = pieces.PieceIds(FILE)
    assert encoder.plain
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == library(text), text


def test_plain_pieces_skip_the_search_for_pre_tokens(library):
    """What op4 and op6 spent most of their CPU seconds on, one search a new piece."""
    text = "Plain words, mostly: 42 of them.\nNaïve été ##"
    expected, encoder = library(text), pieces.PieceIds(FILE)

    class Searched:
        def __init__(self):
            self.texts = []

        def encode(self, text, add_special_tokens):
            self.texts.append(text)
            return Tokenizer.from_file(FILE).encode(text, add_special_tokens=add_special_tokens)

        def encode_batch(self, texts, add_special_tokens):
            return [self.encode(t, add_special_tokens) for t in texts]

    encoder.tokenizer = Searched()
    assert encoder.encode([text]) == [expected]
    assert encoder.tokenizer.texts == [" ##"]


def test_full_memory_keeps_pieces_in_use():
    """Of pieces without end, the frequent ones are encoded once, not after each time it is full."""
    encoder, asked = pieces.PieceIds(FILE, remembered=400), []
    ids = encoder.ids
    encoder.ids = lambda text: asked.append(text) or ids(text)
    for i in range(500):
        encoder.encode([" often " + " ".join(f"rare{i}x{k}" for k in range(10))])
        assert len(encoder) + len(encoder.before) <= 400
    assert asked.count(" often") == 1


def test_other_tokenizers_encode_each_piece_whole(tmp_path, library):
    """An added token within plain pieces, or another pre-tokenizer, rules the short way out."""
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.add_tokens(["ord"])
    tokenizer.save(str(tmp_path / "added.json"))
    encoder = pieces.PieceIds(str(tmp_path / "added.json"))
    assert not encoder.plain
    assert encoder.encode(["a word here"]) == [np.array(tokenizer.encode("a word here").ids, "<u4").tobytes()]
