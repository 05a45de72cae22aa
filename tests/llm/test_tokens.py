"""Cached encoding against the library itself."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewright.llm.contract import tokenizer_path
from tracewright.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
HARD = [
    "", None, " ", "  a", "a  b", "a \n b", "a\n\nb", "it's. I'll, we'd! they'", "ΣΑΣ ΟΔΟΣ. ΣΑΣ", "é É ñ ñ.",
    "x y z", "a\x1cb \x85 c", "1,000.50 3.", "<|endoftext|> a<|startoftext|>.", "a <|endoftext|> b", "A<|EndOfText|> <|endoftext|><|endoftext|>x", "\ttab\r\nend ", "Ünïcödé!!?", "日本語。テスト",
    "🙂🙂 ok.", "İstanbul.", "ǅ, ß.", "a" * 5000, ". , ;", "word.\nWord, word:Word",
]


@pytest.mark.parametrize("file", FILES)
def test_same_ids_as_the_library(file):
    draw = random.Random(3)
    alphabet = ["a", "B", "é", "É", " ", " ", "\n", ".", ",", "'", "s", "7", "Σ", "́", "  ", "-", "ß", "!", "\t", "的", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]
    texts = HARD + ["".join(draw.choices(alphabet, k=draw.randrange(1, 40))) for _ in range(2000)]
    path = tokenizer_path(file)
    encode, library = Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # cold and warm
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, encode.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_words_are_asked_together_and_in_small_calls():
    """Answers of the library are large: one call for all new words of a batch took hundreds of MB."""
    path = tokenizer_path("word_bpe_49k.json")
    encode, library = Encoder(path), Tokenizer.from_file(path)
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **kind):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **kind)

    encode._library = Counted()
    words = ["".join(random.Random(i).choices("abcdeéñ的", k=9)) for i in range(3000)]
    numbers = [f"x{i}y" for i in range(5000)]
    got = np.frombuffer(encode([" ".join(words + numbers)])[0], encode.dtype).tolist()
    assert got == library.encode(" ".join(words + numbers), add_special_tokens=False).ids
    assert max(calls) <= 4096 and sum(calls) < 5100


def test_what_workers_remember_goes():
    from tracewright.llm import batches, minhash

    minhash.shingle_set("a b c")
    assert minhash._known
    batches.give_back()
    assert not minhash._known


def test_what_this_stage_remembers_stays():
    from tracewright.llm import batches, minhash, tokens

    minhash.shingle_set("a b c")
    first = tokens.encoder(tokenizer_path("word_bpe_49k.json"))
    batches.give_back(tokens.ENCODERS)
    assert not minhash._known and tokens.encoder(tokenizer_path("word_bpe_49k.json")) is first
    batches.give_back()
    assert not tokens.ENCODERS


def test_chunks_behind_spaces_are_asked_together():
    path = tokenizer_path("byte_bpe_50k.json")
    encode, library = Encoder(path), Tokenizer.from_file(path)
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **kind):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **kind)

    encode._library = Counted()
    words = ["".join(random.Random(i).choices("abcdeéñ的 1'.-\n\u0120", k=9)) for i in range(3000)]
    words = " ".join(words).split()
    odd = ["a\nb", "a.\nLe", "'s", "x's", "<|endoftext|>", "a<|endoftext|>b", "\u0120", "\u0120a", "e\u0301", "", "12a", "\u2028x"]
    texts = [" ".join(words), " ".join(odd), " a", "a ", "a\n", "\na b", "a  b", "", None, *[f"a {x} b" for x in odd]]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(texts)] == want
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(texts)] == want  # now from memory
    assert len(asked) < len(set(words)) / 20


@pytest.mark.parametrize("file", FILES)
def test_chunks_get_a_number_as_they_are_looked_up(file, monkeypatch):
    """One lookup gives every chunk its place in the answers; only new ones are seen by Python code, also after the tables were emptied."""
    path = tokenizer_path(file)
    encode, library = Encoder(path), Tokenizer.from_file(path)
    asked = []
    ask = encode._ask
    monkeypatch.setattr(encode, "_ask", lambda texts: asked.extend(texts) or ask(texts))
    texts = ["one two, two three. three", "three two. one", None, "", "<|endoftext|> one two"]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(3):
        assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(texts)] == expected
        assert len(encode._later) == len(encode._later.answers) and encode._later.unanswered() == []
    n = len(asked)
    encode(texts)
    assert len(asked) == n  # nothing is asked twice
    monkeypatch.setattr("tracewright.llm.tokens.CACHE_ENTRIES", 2)
    for text, ids in zip(texts, expected, strict=True):
        assert np.frombuffer(encode([text])[0], encode.dtype).tolist() == ids
        assert len(encode._later) <= 2 + 4 + 2
