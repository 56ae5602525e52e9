"""Whole texts to token ids with the tokenizers library, each distinct piece once.

A byte-level BPE never merges across its pre-tokens, and a pre-token never spans a
place between a non-blank character and a blank or line end.  So a text is cut at
these places, each piece new to the worker goes to the tokenizers library, and a
text's ids are the ids of its pieces in order.  Most pieces are letters or digits with
punctuation after them, two pre-tokens whose border is plain: these go to the library's
BPE model as they are, without its search for pre-tokens.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

#: pieces remembered in a Python worker, about 150 bytes each
REMEMBERED = 1_200_000
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: what makes plain splits at blanks and line ends unsafe: runs of them, other white space
ODD = tuple(a + b for a in " \n" for b in " \n") + tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
ODD_ASCII = tuple(s for s in ODD if s.isascii())
#: one pre-token of letters or digits that every Unicode version knows as such, and one of
#: punctuation (an apostrophe may begin a pre-token of its own)
LETTERS, PUNCTUATION = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԣ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"([{LETTERS}]+|[0-9]+)([{PUNCTUATION}]*)")
#: what may lie in such a piece
INSIDE = re.compile(f"\n? ?[{LETTERS}0-9]*[{PUNCTUATION}]*")
#: the first character of a key that stands for the rest of the key as it is
AS_IS = "\r"


def cut(text: str) -> list[str]:
    """The keys of a text's pieces, in order: a word for the blank and the word, a line end
    and a word for themselves, and ``AS_IS`` before any other piece."""
    if any(map(text.__contains__, ODD_ASCII if text.isascii() else ODD)):
        return [AS_IS + p for p in CUT.split(text) if p]
    # single blanks and line ends only: plain splits at them find the same places
    out = text.replace("\n", " \n").split(" ")
    if out[0]:
        out[0] = AS_IS + out[0]
        return out
    return out[1:]


def piece(key: str) -> str:
    return key[1:] if key[:1] == AS_IS else key if key[:1] == "\n" else " " + key


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class PieceIds(dict):
    """ids of whole texts as little-endian unsigned 32-bit integers; key of a piece -> ids."""

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(tokenizer_file, encoding="utf-8") as f:
            made = json.load(f)
        splits = made.get("pre_tokenizer") or {}
        self.plain = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
        self.plain &= made["model"].get("type", "BPE") == "BPE" and not made.get("normalizer") and not made.get("post_processor")
        self.plain &= not any(INSIDE.fullmatch(t["content"]) for t in made.get("added_tokens", ()))
        self.half = max(1, remembered // 2)
        #: pieces met before the last time the memory was half full
        self.before: dict[str, bytes] = {}
        #: ids of pre-tokens that follow others: punctuation
        self.tails: dict[str, bytes] = {"": b""}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.ids(piece(key))
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of one piece."""
        end, blank = text[:1] == "\n", text[:1] == " "
        match = PLAIN.fullmatch(text, end or blank) if self.plain else None
        if match is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        body, tail = match.groups()
        out = self.pre_token(" " + body if blank else body)
        if tail or end:
            for t in ("\n" if end else "", tail):
                if t not in self.tails:
                    if len(self.tails) >= 10_000:
                        self.tails = {"": b""}
                    self.tails[t] = self.pre_token(t)
            out = (self.tails["\n"] if end else b"") + out + self.tails[tail]
        return out

    def pre_token(self, text: str) -> bytes:
        if text.isascii() and text.isalnum():
            chars = text
        else:
            chars = "".join(map(self.letters.__getitem__, text.encode()))
        ids = [t.id for t in self.model.tokenize(chars)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text (null: empty) the bytes of its ids."""
        return [b"".join(map(self.__getitem__, cut(t))) if t else b"" for t in texts]


@lru_cache(maxsize=4)
def piece_ids(tokenizer_file: str) -> PieceIds:
    return PieceIds(tokenizer_file)
