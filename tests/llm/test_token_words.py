"""Words of token files: cut where the tokenizer cuts, encoded once, in little memory."""

import random
from functools import lru_cache

import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Whitespace

from carelake.llm import token_files as T


def _encoder():
    with open(T.default_tokenizer(), encoding="utf-8") as f:
        return T.WordEncoder(f.read())


@lru_cache(1)
def _tokenizer():
    return Tokenizer.from_file(T.default_tokenizer())


def _plain(texts):
    return [i for t in texts for i in [*_tokenizer().encode(t, add_special_tokens=False).ids, T.END]]


def test_a_word_is_encoded_once_whatever_follows_it():
    encoder, given, was = _encoder(), [], T.WordEncoder._encoded
    encoder._encoded = lambda words: given.extend(words) or was(encoder, words)
    texts = ["lorem, (lorem) lorem.", "lorem; lorem! 7-lorem/lorem", "lorem's lorem"]
    ids, _ = encoder.encode(pa.array(texts))
    assert ids.tolist() == _plain(texts) and given.count("lorem") == 1 and sum("lorem" in w for w in given) == 2  # and lorem's


def test_odd_words_have_the_ids_of_their_text():
    letters = list("abzTW019 .,!?'-/<>|=&#\t\n") + [
        "'s", "'re", "T̈", "̈", "≠", "…", "é", "é", "Σ", "ς", "İ", "漢", " ", "　", "​", "👩‍🚀",
        "<|endoftext|>", "<|ENDOFTEXT|>", "½", "ǅ", "\x00", "\x85", "ᄀ", "ᅡ", "’s",
    ]
    r = random.Random(3)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    encoder = _encoder()
    got = [i for k in range(0, len(texts), 40) for i in encoder.encode(pa.array(texts[k : k + 40]))[0].tolist()]
    assert got == _plain(texts)


def test_other_tokenizers_get_words_between_white_space():
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    tokenizer.pre_tokenizer = Whitespace()
    assert _encoder().parted is not None and T.WordEncoder(tokenizer.to_str()).parted is None


@pytest.mark.parametrize("n", [1, 3000])
def test_a_full_memory_starts_again(monkeypatch, n):
    monkeypatch.setattr(T, "CACHE_WORDS", 500)
    encoder = _encoder()
    for k in range(0, 6000, n * 20):
        texts = [" ".join(f"{x:x}y" for x in range(i, i + 20)) for i in range(k, k + 20 * n, 20)]
        assert encoder.encode(pa.array(texts))[0].tolist() == _plain(texts)
        assert len(encoder.size) <= max(3 * len(encoder.keys) // 4, 1)
    assert encoder.keys.nbytes + encoder.values.nbytes <= 12 * max(2 * 500, 2 * 20 * n)
