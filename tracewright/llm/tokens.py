"""Token ids of whole texts, by public tokenizer files and the tokenizers library."""

from __future__ import annotations

import re
import unicodedata
from itertools import islice

import numpy as np

from tracewright.llm.batches import REMEMBERED

CACHE_ENTRIES = 600_000  # chunks remembered by a Python worker in each of two tables, about 200 bytes each
_ASKED = 4096  # chunks in one call of the library, whose answers are about 1 kB each
_TOGETHER = 200  # words in one text of such a call
_STOPS = ".,;:!?"
_SPACE = "\u0120"  # how byte-level tokenizers write a space
_NOT_SINGLE_SPACES = re.compile(r"\s\s")
ENCODERS: dict[str, Encoder] = {}
REMEMBERED.append(ENCODERS)


class _Chunks(dict):
    """Numbers of chunks and, in `answers`, their ids; looking up a new chunk gives it the next number."""

    def __init__(self):
        super().__init__()
        self.answers: list[bytes] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number

    def unanswered(self) -> list[str]:
        return list(islice(reversed(self), len(self) - len(self.answers)))[::-1]

    def bound(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.answers.clear()


class Encoder:
    """Encodes texts as the library does with add_special_tokens=False.

    The tokenizers used here never join the characters on both sides of a single space inside one
    piece, so the library only has to see every distinct chunk between single spaces once; equal
    chunks are looked up. Texts with other runs of white space go to the library whole. Strings of
    special tokens have no space and are what the library makes of them. None is an empty text.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._library.get_vocab_size() <= 1 << 16 else "<u4")
        self._first = _Chunks()
        self._later = _Chunks()
        self._stops: dict[str, bytes] = {}
        self._folds = self._ask(["A\nB "]) == self._ask(["a b"])
        # a tokenizer that marks the last id of a word, whatever stands around the word, or the first id behind a space
        suffix = getattr(self._library.model, "end_of_word_suffix", None)
        self._ends = self._starts = None
        if not self._folds and self._ask([" a, b"]) == [b"".join(self._ask([" a,", " b"]))]:
            self._starts = np.zeros(self._library.get_vocab_size(), bool)
            self._starts[[i for token, i in self._library.get_vocab().items() if token.startswith(_SPACE)]] = True
        if suffix and self._folds and self._ask([" a b"]) == [b"".join(self._ask(["a", "b"]))]:
            self._ends = np.zeros(self._library.get_vocab_size(), bool)
            self._ends[[i for token, i in self._library.get_vocab().items() if token.endswith(suffix)]] = True

    def _ask(self, texts: list[str]) -> list[bytes]:
        encode, answers = self._library.encode_batch_fast, []
        for at in range(0, len(texts), _ASKED):
            answers += [np.array(e.ids, self.dtype).tobytes() for e in encode(texts[at:at + _ASKED], add_special_tokens=False)]
        return answers

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """As `_ask`, for words of letters only: many go to the library as one text and are told apart by their last ids."""
        groups = [words[at:at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        answers = []
        for group, ids in zip(groups, self._ask([" ".join(g) for g in groups]), strict=True):
            ends = (np.flatnonzero(self._ends[np.frombuffer(ids, self.dtype)]) + 1) * self.dtype.itemsize
            if len(ends) != len(group):
                answers += self._ask(group)
                continue
            at = 0
            for end in ends.tolist():
                answers.append(ids[at:end])
                at = end
        return answers

    def _ask_spaced(self, chunks: list[str]) -> list[bytes]:
        """As `_ask`, for chunks with a space before each: many go to the library as one text and are told apart by their first ids."""
        groups = [chunks[at:at + _TOGETHER] for at in range(0, len(chunks), _TOGETHER)]
        answers = []
        for group, ids in zip(groups, self._ask([" " + " ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self._starts[np.frombuffer(ids, self.dtype)]) * self.dtype.itemsize
            if len(starts) != len(group) or starts[0]:
                answers += self._ask([" " + c for c in group])
                continue
            cuts = [*starts.tolist(), len(ids)]
            answers += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return answers

    def _learn(self, known: _Chunks, prefix: str) -> None:
        """Answer all chunks that were looked up and have none."""
        # a letter and the full stops or commas behind it are in different pieces
        cores = {}
        for chunk in known.unanswered():
            core = chunk.rstrip(_STOPS)
            if core and core != chunk and core[-1].isalpha():
                cores[chunk] = core
                known[core]  # a chunk as well
        new = known.unanswered()
        if not new:
            return
        ask = [c for c in new if c not in cores]
        found: dict[str, bytes] = {}
        if self._ends is not None:
            words = [c for c in ask if c.isalpha()]
            found.update(zip(words, self._ask_words(words), strict=True))
            ask = [c for c in ask if not c.isalpha()]
        if self._starts is not None and prefix == " ":
            # white space at an end would meet that of the next chunk, and special tokens may take some with them
            alone = [c for c in ask if not c or "<" in c or c[0].isspace() or c[-1].isspace()]
            apart = set(alone)
            words = [c for c in ask if c not in apart]
            found.update(zip(words, self._ask_spaced(words), strict=True))
            ask = alone
        found.update(zip(ask, self._ask([prefix + c for c in ask]), strict=True))
        tails = {c[len(core):] for c, core in cores.items()}.difference(self._stops)
        self._stops.update(zip(tails, self._ask(list(tails)), strict=True))
        before = len(known.answers)
        for chunk, core in cores.items():
            number = known[core]
            found[chunk] = (known.answers[number] if number < before else found[core]) + self._stops[chunk[len(core):]]
        known.answers += map(found.__getitem__, new)

    def _fold(self, text: str) -> str:
        """For a tokenizer that lowers letters and drops white space: the same text with fewer different chunks.

        Special tokens are only those in their own letters, so texts that may have one stay.
        """
        if "\u03a3" in text or "<|" in text or not unicodedata.is_normalized("NFC", text):
            return text
        return text.lower().replace("\n", " ")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids, little-endian, each as wide as `dtype`."""
        whole: dict[int, bytes] = {}
        split = []
        for i, text in enumerate(texts):
            text = self._fold(text) if text and self._folds else text
            if not text:
                whole[i] = b""
                split.append(None)
            elif _NOT_SINGLE_SPACES.search(text):
                whole[i] = self._ask([text])[0]
                split.append(None)
            else:
                split.append(text.split(" "))
        first, later = self._first, self._later
        first.bound()
        later.bound()
        begins = [s and first[s.pop(0)] for s in split]
        found = [s and list(map(later.__getitem__, s)) for s in split]
        self._learn(first, "")
        self._learn(later, " ")
        answer = later.answers.__getitem__
        return [whole[i] if s is None else first.answers[begins[i]] + b"".join(map(answer, numbers or ()))
                for i, (s, numbers) in enumerate(zip(split, found, strict=True))]


def encoder(path: str) -> Encoder:
    """The encoder of a file, one per Python worker."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]
