"""Ids against the tokenizer itself, text by text."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "é", "ж", "中", "文", "1", "٣", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "　", "​", "'", "s", "'ll", "'t", "!", "?", "<|endoftext|>", "<|", "😀", "क", "ि", "²", "Ⅷ", "_", "ᏸ", " ab", " ab", " ab"]


def expected(text: str) -> list[int]:
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def ids(text: str) -> list[int]:
    return np.frombuffer(tokens.encoder(PATH)(text), "<u4").tolist()


def test_mixed_texts(monkeypatch):
    rng, whole = random.Random(3), Tokenizer.from_file(PATH)
    for size in (30, tokens.PIECE):
        monkeypatch.setattr(tokens, "PIECE", size)
        for _ in range(1500):
            text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 150)))
            assert ids(text) == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", " " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "abcdefghij" * 500_000, ("word, " * 300_000)[:-1]], ids=["empty", "mark", "marks", "blanks", "newlines", "one word", "many words"])
def test_odd_and_long_texts(text):
    assert ids(text) == expected(text)


def test_pieces_of_odd_texts(spark):
    texts = [None, "", "x <|endoftext|> y", " " * 50_000, "wort " * 5_000]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for doc, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        want = np.array([*expected(text or ""), 1], "<u4")
        assert [r["start"] for r in own] == list(range(0, len(want), packing.SIZE))
        assert all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(want) for r in own)
