"""Token ids of whole texts as packed little-endian 32-bit integers, with a cache of the pieces between spaces.

Byte-level BPE with the usual splitting pattern always begins a new token at a
single space between two characters that aren't white space. Texts are cut at
such spaces, and each distinct piece is encoded once, while it is remembered. A text
with white space beside a space is cut by a pattern that looks at both sides. The
ids are those that ``tokenizers`` gives for the whole text with the tokenizer
file; tests compare them. A rank file of the same vocabulary beside it is used for
single pieces, which is faster, if at start both agree on every tenth token and on
``SAMPLES``; without one, or if they don't agree, ``tokenizers`` encodes all.

Defined results: an empty text has no ids; special tokens' strings in a text give
what ``tokenizers`` gives for them.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Pieces that are remembered at most; half of them make a generation, and those that the older one has and the younger hasn't go.
CACHE_ENTRIES = 250_000
_SAFE = re.compile(r"(?<=\S)(?= \S)")


#: A run of these after a letter or digit is a token sequence of its own (an apostrophe may not be).
_MARKS = ".,;:!?*#%&$|)(]["


class _Gap(Exception):
    """White space on both sides of a space: the text isn't cut there."""


class _Cache(dict):
    """Ids of pieces; those behind a space when ``lead`` is one."""

    def __init__(self, encode, single, lead: str = "") -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.encode, self.single, self.lead = encode, single, lead

    def __missing__(self, piece: str) -> bytes:
        if self.lead and (not piece or piece[0].isspace()):
            raise _Gap
        if len(self) >= CACHE_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        if (made := self.old.get(piece)) is not None:
            self[piece] = made
            return made
        stem = piece.rstrip(_MARKS)
        if stem != piece and stem and stem[-1].isalnum():
            made = self[stem] + self.encode(piece[len(stem) :])
        elif self.single and piece.isalpha():  # one token sequence without a boundary inside
            made = array("I", self.single((self.lead + piece).encode())).tobytes()
        else:
            made = self.encode(self.lead + piece)
        self[piece] = made
        return made


class Plan:
    """How texts are encoded: the tokenizer file, the rank file if both agree, and the special tokens. Made once, and sent to tasks."""

    def __init__(self, path: str, fast_path: str | None = None) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.path, self.ranks = path, fast_path or re.sub(r"\.json$", ".tiktoken", path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if not os.path.exists(self.ranks) or not agree(tokenizer, quick_encoder(self.ranks)):
            self.ranks = None


class Encoder:
    """``Encoder(path)(text)``: the ids as bytes, four for each. ``tokenizers`` is loaded when it is needed."""

    def __init__(self, path: str | Plan, fast_path: str | None = None) -> None:
        plan = path if isinstance(path, Plan) else Plan(path, fast_path)
        self.path, self.special = plan.path, plan.special
        self.quick = quick_encoder(plan.ranks) if plan.ranks else None
        single = self.quick and self.quick.encode_single_piece
        self.first = _Cache(self._encode, single)
        self.later = _Cache(self._encode, single, " ")

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _encode(self, piece: str) -> bytes:
        if self.quick and not any(s in piece for s in self.special):
            return array("I", self.quick.encode_ordinary(piece)).tobytes()
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(" " in s and s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        try:
            return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))
        except _Gap:
            return b"".join(map(self._encode, _SAFE.split(text)))


SAMPLES = ("the quick brown fox", " it's we'll 12345", "naïve Größe 東京 🙂", "a\tb\n\n c  d", "x" * 50, "don't!!! (e.g.) [1] ", " \u00a0\u2028 ", "0x1f && b||c")


def agree(tokenizer: Tokenizer, quick) -> bool:
    """Whether both encode ``SAMPLES`` and every tenth token of the vocabulary alike."""
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    numbers = sorted(i for t, i in tokenizer.get_vocab().items() if t not in special)[::10]
    texts = [*SAMPLES, *(t for t in map(tokenizer.decode, ([i] for i in numbers)) if "\ufffd" not in t)]
    return all(list(quick.encode_ordinary(t)) == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


def quick_encoder(ranks_path: str):
    """An encoder by a rank file, without special tokens."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding(os.path.basename(ranks_path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder._core_bpe
