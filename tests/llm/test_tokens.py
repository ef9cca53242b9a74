"""Ids of pieces put together against the tokenizer's own for whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparktn.llm import tokens
from sparktn.llm.queries import tokenizer_path

ALPHABET = [*"aAbzZ019.,!?'\"-_()#<|> \n\t\r\x0b\x0c\x1c\x1f\x00\x7f", "'s", "'S", "'ll", "é", "É", "ß", "×", "÷", "̀", "J̌", "İ", "Σ", "\xa0", "\x85", "　", "²", "ª", "”", "–", "œ", "汉字", "😀", "​", "Å", "<|endoftext|>"]


@pytest.mark.parametrize("part", [7, 50, tokens.PART])
def test_ids_are_the_tokenizers(part, monkeypatch):
    monkeypatch.setattr(tokens, "PART", part)
    draw = random.Random(part)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 25))) for _ in range(3000)] + ["", "   ", "word " * 500, "x" * 500]
    whole = Tokenizer.from_file(tokenizer_path())
    want = [np.asarray(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(tokenizer_path(), 500).encode(texts) == want


def test_nulls_empty_and_sliced_arrays():
    own = tokens.Encoder(tokenizer_path())
    assert own.encode([]) == []
    assert own.encode([None, ""]) == [b"", b""]
    column = pa.array(["gone", "a b", None, "c"])
    assert own.encode(column[1:]) == own.encode(["a b", "", "c"])
