import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from carelake.llm import textbytes as X
from carelake.llm import token_files as T


def thue_morse(n: int) -> tuple[str, str]:
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_words_apart():
    words = [*thue_morse(2048), *thue_morse(64), "a", "b", "ab", "ba", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaab", "a\0b", "漢字", "é" * 9, "x" * 100_000, "x" * 99_999 + "y"]
    found = X.words_of(pa.array([" ".join(words)]), X.SPACED, lower=False)
    raw = found.buf.tobytes()
    assert [raw[a:b].decode() for a, b in zip(found.starts, found.ends, strict=True)] == words
    assert len(set(found.hashes().tolist())) == len(words)
    # a word's hash does not depend on where it stands
    alone = [X.words_of(pa.array([f" \t{w}"]), X.SPACED, lower=False).hashes()[0] for w in words]
    assert found.hashes().tolist() == alone


def plain(texts):
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    return [tokenizer.encode(t, add_special_tokens=False).ids + [T.END] for t in texts]


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_with_one_hash_keep_their_own_ids(monkeypatch):
    texts = [" ".join(thue_morse(2048)), "one two three", "three two four longerword anotherword", "", "longerwore one"]
    with open(T.default_tokenizer()) as f:
        encoder = T.WordEncoder(f.read())
    assert split(*encoder.encode(pa.array(texts))) == plain(texts)
    # the worst case: all words of a length share a hash
    monkeypatch.setattr(X.Words, "hashes", lambda self: (self.ends - self.starts).astype(np.uint64))
    with open(T.default_tokenizer()) as f:
        encoder = T.WordEncoder(f.read())
    for _ in range(2):
        assert split(*encoder.encode(pa.array(texts))) == plain(texts)
