"""Piece-wise encoding against the library on whole texts."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts():
    rng = np.random.default_rng(1)
    made = ["".join(map(chr, rng.choice([*range(32, 127), 10, 9, 13, 0x1C, 0x85, 0xA0, 0xD7, 0xE9, 0x17F, 0x180, 0x2003, 0x3000, 0x4E2D, 0x1F600, 0x301], rng.integers(0, 60)))) for _ in range(4000)]
    close = [" ", "\n", ",", ".", "'", "s", "é", "a", "1", "\u00a0"]
    made += ["".join(rng.choice(close, rng.integers(1, 12))) for _ in range(6000)]
    return made + ["", "x" * 3000 + " " + "y," * 3, "<|endoftext|> a", "Ċ Ġ", "", "", "a\n b", " lead", "trail "]


def test_ids_equal_the_library_s_on_adversarial_texts():
    made, t, e = texts(), library(), tokens.library_encoder(PATH)
    for _ in range(2):  # the second time all pieces are known
        got = e.of_texts(made)
        assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in made]


def test_windows_forgetting_and_clashes_of_hashes(monkeypatch):
    made, t, e = texts()[::7] + ["a" * 5000, "b c " * 900], library(), tokens.library_encoder(PATH)
    want = [t.encode(x, add_special_tokens=False).ids for x in made]
    monkeypatch.setattr(tokens, "WINDOW_BYTES", 100)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    monkeypatch.setattr(tokens, "KEPT_BYTES", 5)
    assert [x.tolist() for x in e.of_texts(made)] == want
    e.forget()
    monkeypatch.setattr(tokens, "KEPT_PIECES", 1 << 20)
    monkeypatch.setattr(tokens, "_powers", lambda n: (np.ones(n, np.uint64), np.ones(n, np.uint64)))  # anagrams clash
    assert [x.tolist() for x in e.of_texts(made)] == want
    e.forget()


def test_wide_vocabularies_keep_32_bits():
    learn = tokens.library_encoder(PATH).learn
    e = tokens.PieceEncoder(learn, 1 << 17)
    assert e.of_texts(["a b"])[0].dtype == np.dtype("<u4") and tokens.library_encoder(PATH).of_texts(["a b"])[0].dtype == np.dtype("<u2")
