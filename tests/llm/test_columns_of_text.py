"""Encoding of whole Arrow columns against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pixelquilt.llm import encoding
from pixelquilt.llm.encoding import Encoder, load_tokenizer

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def expected(name, texts):
    return [np.array(e.ids, dtype="<u4").tobytes() for e in load_tokenizer(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_columns_encode_as_whole_texts(name, monkeypatch):
    pieces = ["\t", "\n", "\x0b", "\x1c", " ", "  ", "\0", "\x85", "\xa0", " ", " ", "　", "a", "É", "İ", "Σ", "!", "?", ".", ",", "#", "<|endoftext|>", "<|", "it's", "'", "́", "12", "日本", "😀"]
    draw = random.Random(3)
    texts = [None, "", " "] + ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(2000)] + [None]
    texts += [f"a{chr(c)}.b {chr(c)} x{chr(c)}," for c in range(0x3100)]
    for size in (1 << 23, 64):  # in one block, and in many, with texts that are longer than one
        monkeypatch.setattr(encoding, "BLOCK_BYTES", size)
        column = pa.array(["before", *texts])[1:]
        assert Encoder(name).column(column) == expected(name, texts)
    assert Encoder(name).column(pa.array([], pa.string())) == [] and Encoder(name).column(pa.array([None, ""])) == [b"", b""]


@pytest.mark.parametrize("name", NAMES)
def test_a_word_before_punctuation_is_encoded_once(name):
    own = Encoder(name)
    make, asked = own.memory.make, []
    own.memory.make = lambda unknown: asked.extend(unknown) or make(unknown)
    texts = [f"see house. see house, see house; see house: see house! see house? {i % 2}" for i in range(50)]
    assert own.column(pa.array(texts)) == expected(name, texts)
    assert sorted(asked) == sorted(["see", " see", " house", ".", ",", ";", ":", "!", "?", " 0", " 1"])


def test_the_library_gets_bounded_batches(monkeypatch):
    monkeypatch.setattr(encoding, "BATCH_SEGMENTS", 8)
    sizes = []

    class Counted:
        def encode_batch(self, batch, add_special_tokens):
            sizes.append(len(batch))
            return load.encode_batch(batch, add_special_tokens=add_special_tokens)

    load = load_tokenizer(NAMES[1])
    monkeypatch.setattr(encoding, "load_tokenizer", lambda name: Counted())
    text = " ".join(f"w{i}x" for i in range(100))
    assert Encoder(NAMES[1]).column(pa.array([text])) == expected(NAMES[1], [text])
    assert sum(sizes) == 100 and max(sizes) == 8
