"""Limits of shard files, and an encoder that many tasks share."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from silvagrid.llm import wavelet
from tests.llm.test_operators import prose, texts


def test_ids_beyond_the_planes():
    with pytest.raises(ValueError, match="16 planes do not hold the id 70000"):
        wavelet.write_shard(np.array([1, 70000], np.uint32), [1], np.array([2]), 16)
    matrix, keys, lengths = wavelet.read_shard(wavelet.write_shard(np.array([1, 70000, 65535], np.uint32), [None], np.array([3]), 17))
    assert matrix.values().tolist() == [1, 70000, 65535] and keys == [None] and lengths.tolist() == [3]
    empty = wavelet.read_shard(wavelet.write_shard(np.zeros(0, np.uint32), [], np.zeros(0, np.int64), 16))[0]
    assert empty.values().tolist() == []


def test_shared_encoder(monkeypatch):
    """What an encoder remembers of earlier texts, and what it forgets, changes no ids."""
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, shared = Tokenizer.from_file(path), wavelet.encoder(path)
    assert wavelet.encoder(path) is shared
    given = [t or "" for t in texts()] + [prose(i, 80) for i in range(12)]
    for part in (given[:9], given[9:], given[::-1], given):
        want = [x.ids for x in plain.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in shared(part)] == want


def test_words_of_a_batch_are_asked_for_once():
    encode, asked = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []

    class Known(dict):
        def __getitem__(self, word):
            asked.append(word)
            return encode._word(word)

    encode.known = Known()
    texts = ["lone", "", "one two one two, one", "é one  two", "two\n one", "a\n", " one", "one \ttwo one<|endoftext|>", "a. two"] * 20
    got = encode(texts)
    assert len(asked) == len(set(asked))
    whole = encode.coder.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.tolist() for x in got] == [list(x.ids) for x in whole]


def test_a_word_is_encoded_once_with_any_tail():
    encode, asked = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    tokenize = encode.tokenize
    encode.tokenize = lambda piece: asked.append(piece) or tokenize(piece)
    texts = ["a lone word", "a lone, word. lone?) word!", "x y a lone", "é über, über über. ×, ɐ", "", "a lone word,"]
    got = [[x.tolist() for x in encode(texts[:2])], [x.tolist() for x in encode(texts)]]
    assert len(asked) == len(set(asked))
    whole = [list(x.ids) for x in encode.coder.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == [whole[:2], whole]


@pytest.mark.parametrize("narrow", [wavelet.NARROW, 100])
def test_sixteen_planes_take_three_sorts(monkeypatch, narrow):
    monkeypatch.setattr(wavelet, "NARROW", narrow)
    order, asked = wavelet._order, []
    monkeypatch.setattr(wavelet, "_order", lambda digits: asked.append(len(digits)) or order(digits))
    ids = np.random.default_rng(3).integers(0, 50257, 3000).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    assert asked == [3000] * 3 and len(matrix.planes) == 16
    assert (matrix.values() == ids).all() and asked == [3000] * 6
    at = np.array([0, 1, 7, 8, 511, 512, 513, 2999, 3000])
    top = ids >> 12
    for digit in range(16):
        assert matrix.rank(0, digit, at).tolist() == [int((top[:i] == digit).sum()) for i in at]
