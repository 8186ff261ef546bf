"""Byte-level BPE encoding on executors: ids as the ``tokenizers`` library gives them.

The vocabulary's file is a parameter, the name of a public tokenizer or a path that all executors can read."""

from __future__ import annotations

import json
import os
from array import array

SPECIAL = "<|endoftext|>"
#: pre-tokens whose counts a worker keeps
CACHE = 400_000
DEFAULT = "byte_bpe_50k.json"
_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = DEFAULT) -> Encoder:
    """One encoder per worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabulary: printable Latin-1 bytes stand for themselves, the rest follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """ids(text) gives little-endian unsigned 32-bit ids; count(text) their number.

    Texts with the special token's string go to the ``tokenizers`` library, which gives it an id of its own; all others
    to the same vocabulary's ranks in ``tiktoken``, which merges alike and faster."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self.pattern = public_tokenizers.PATTERN
        self.ranks = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.counts: dict[str, int] = {}

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).tobytes()

    def count(self, piece: str) -> int:
        """Number of ids of one pre-token; the counts of as many as CACHE are kept."""
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= CACHE:
                self.counts.clear()
            n = self.counts[piece] = len(self.ranks.encode_ordinary(piece))
        return n
