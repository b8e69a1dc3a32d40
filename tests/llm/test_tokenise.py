"""Fast encoders against the untouched library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from freshet.llm import tokenise

FILES = {"byte_bpe_50k.json": tokenise.FastEncoder, "word_bpe_49k.json": tokenise.WordEndEncoder}
PARTS = [
    "a", "B", "don't", "'S", "'Ve", "it's", "...", "..,", "'tis", "İ.", "i̇,", "Σ", "ΑΣ", "ΣΑΣ.", "क़.", "ड़,", "ਲ਼.", "יִ,", "é", "é", "ﬁ", "ẞ", "½", "²", "12", "_", "x_y", " ", "  ", "\n", "\t", "\r\n",
    "\xa0", " ", "\x1c", "\x0b", "\x85", "​", "日本", "한국", "각", "😀", "𝄞", "𐐀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "'", "''", "'re", "'LL", "ſ", "'ſ", "K", "ͅ", "ǅ", "Ⅷ", "٣", "﻿", "\x00", "~", " .", ", ", "a.b,c",
]


def expected(path, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_odd_strings(name):
    rng = random.Random(11)
    points = [*range(0x20, 0x3000), *(c for c in range(0x3000, 0x110000, 37) if not 0xD800 <= c < 0xE000)]
    texts = ["".join(rng.choice(PARTS) if rng.random() < 0.7 else chr(rng.choice(points)) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    path = public_tokenizers.path(name)
    encoder = tokenise.encoder_of(path)
    assert type(encoder) is FILES[name]
    wrong = [t for t, a, b in zip(texts, encoder.batch(texts), expected(path, texts), strict=True) if a != b]
    assert wrong == []


@pytest.mark.parametrize("name", FILES)
def test_each_character(name):
    path = public_tokenizers.path(name)
    texts = [f"A{chr(c)}b 1{chr(c)}2 {chr(c)}.{chr(c)} ?" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    got = tokenise.encoder_of(path).batch(texts)
    assert [t for t, a, b in zip(texts, got, expected(path, texts), strict=True) if a != b] == []


@pytest.mark.parametrize("name", FILES)
def test_very_long_texts(name):
    path = public_tokenizers.path(name)
    texts = [" " * 300_000 + "a", "." * 20_000, "ab " * 50_000, "\n" * 300_000]
    assert tokenise.encoder_of(path).batch(texts) == expected(path, texts)


def test_other_files_go_to_the_library(tmp_path):
    from tokenizers import models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.save(str(tmp_path / "words.json"))
    encoder = tokenise.encoder_of(str(tmp_path / "words.json"))
    assert type(encoder) is tokenise.Encoder
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(["a b c", ""])] == [[0, 1, 2], []]
