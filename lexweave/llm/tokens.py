"""Ids of whole texts by a file of the ``tokenizers`` library.

A byte-level tokenizer cuts a text into runs of letters, digits, signs and blanks and merges bytes inside a
run alone. Two libraries do so by the same rule, and ``tokenizers`` takes five times as long. So a plain
text, of characters whose class is beyond doubt and without long blank runs, goes through ``tiktoken`` with
the vocabulary of the very file; all others, and those with a string that the file adds to the vocabulary
(an end mark), go to the tokenizer itself. The ids are the tokenizer's in both cases; tests compare them.
A file whose tokenizer works in another way serves every text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

#: Letters whose class no version of the character tables has changed: Latin, Cyrillic, common Han.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ一-鿿"
LONG_BLANKS = 256
#: A single blank between two characters that are none begins a run, whatever stands around.
BETWEEN = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
#: Texts are cut between words about every PIECE characters.
PIECE = 1 << 19


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, the others in order from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str) -> None:
        self.path = path
        tokenizer = self._tokenizer()
        added = tokenizer.get_added_tokens_decoder()
        odd = [rf"[^\x00-\x7f{LETTERS}]", rf"[\t-\r ]{{{LONG_BLANKS}}}", *(re.escape(x.content) for x in added.values())]
        self.odd = re.compile("|".join(odd))
        # no added string may reach over a cut between words
        self.cuts = self._bytewise(tokenizer) and not any(" " in x.content or x.lstrip or x.rstrip or x.single_word for x in added.values())
        self.plain = self._plain(tokenizer, {n for n in added}) if self.cuts else None

    def _tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded when the first text needs it."""
        return self._tokenizer()

    def _bytewise(self, tokenizer: Tokenizer) -> bool:
        cut = tokenizer.pre_tokenizer
        return isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and tokenizer.normalizer is None

    def _plain(self, tokenizer: Tokenizer, added: set[int]):
        import tiktoken

        byte = byte_of()
        ranks = {bytes(map(byte.__getitem__, x)): n for x, n in tokenizer.get_vocab(with_added_tokens=False).items() if n not in added}
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self._piece, pieces(text) if self.cuts else [text]))

    def _piece(self, text: str) -> bytes:
        if self.plain is None or self.odd.search(text):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return self.plain(text).astype("<u4", copy=False).tobytes()


def pieces(text: str) -> Iterator[str]:
    """A text cut between words, about every PIECE characters."""
    at = 0
    while len(text) - at > PIECE and (cut := BETWEEN.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, once in each worker."""
    return Encoder(path)
