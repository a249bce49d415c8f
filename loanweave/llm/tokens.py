"""Whole texts to ids of a byte-level BPE vocabulary, inside tasks.

The tokenizers library costs microseconds per word, and corpora repeat their words. A boundary of
the vocabulary's word pattern lies before every single space between two non-space characters,
around a single line end between such, and between a letter and one closing comma or full stop.
So a text may be cut there, each distinct cut encoded once by the library, and the ids put together
again: the result is exactly that of the library on the whole text. A text with any other spacing
(runs of white space, white space at an end) is handed to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

CLOSING = (",", ".")
CACHED_CUTS = 1_000_000  # distinct cuts kept per worker; beyond it the cache starts anew


class _Numbered(dict):
    """Numbers its keys in order of first use; ``fresh`` holds those not yet resolved."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Encoder:
    """Ids of whole texts, with a bounded cache of cuts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.closing = np.array(
            [self.library.encode(c, add_special_tokens=False).ids[0] for c in CLOSING], np.uint32
        )
        self._start_anew()

    def _start_anew(self) -> None:
        self.cuts, self.words = _Numbered(), _Numbered()
        self.of_cut, self.of_word = _Spans(), _Spans()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, ids per text)."""
        if len(self.cuts) > CACHED_CUTS:
            self._start_anew()
        number, counts, flat = self.cuts.__getitem__, [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            # The zero character marks cuts without a space, so a text that holds it is taken whole.
            parts = ("\0" + text.replace("\n", " \n \0")).split(" ") if "\0" not in text else [" "]
            counts.append(len(parts))
            flat.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        counts = np.asarray(counts, np.int64)
        if not flat:
            return np.zeros(0, np.uint32), counts
        self._resolve()
        cut = np.concatenate(flat)
        size = self.of_cut.size[cut]
        owner = np.repeat(np.arange(len(texts)), counts)
        unsafe = np.unique(owner[size < 0])
        if len(unsafe):
            size = np.where(np.isin(owner, unsafe), 0, size)
        ids = self.of_cut.pool[spans(self.of_cut.begin[cut], size)]
        counts = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return self._with_whole(texts, ids, counts, unsafe) if len(unsafe) else (ids, counts)

    def _with_whole(self, texts, ids, counts, unsafe) -> tuple[np.ndarray, np.ndarray]:
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        found = self.library.encode_batch([texts[i] for i in unsafe], add_special_tokens=False)
        for i, encoding in zip(unsafe, found):
            pieces[i] = np.asarray(encoding.ids, np.uint32)
            counts[i] = len(pieces[i])
        return np.concatenate(pieces), counts

    def _of_words(self, words: list[str]) -> list[list[int]]:
        """Ids per word. Latin letters alone are one piece of the pattern: the library's merge
        model takes them directly, at a third of the cost; all else goes through its front door."""
        found: list[list[int]] = [[]] * len(words)
        one = [i for i, w in enumerate(words) if w.removeprefix(" ").isalpha() and max(w) < "\u0250"]
        letters = "\n".join([words[i] for i in one]).encode().decode("latin-1")
        tokenize, end = self.library.model.tokenize, chr(LETTERS[10])
        for i, word in zip(one, letters.translate(LETTERS).split(end)):
            found[i] = [token.id for token in tokenize(word)]
        rest = sorted(set(range(len(words))).difference(one))
        encodings = self.library.encode_batch_fast(
            [words[i] for i in rest], add_special_tokens=False
        )
        for i, encoding in zip(rest, encodings):
            found[i] = encoding.ids
        return found

    def _resolve(self) -> None:
        """Ids of the fresh cuts: those of the word, and of one closing comma or full stop."""
        fresh, self.cuts.fresh = self.cuts.fresh, []
        if not fresh:
            return
        number, base, tail = self.words.__getitem__, [], []
        for cut in fresh:
            if cut == "\n":
                kind, word = 0, "\0\n"
            elif _unsafe(cut):
                kind, word = -1, "\0\n"
            elif cut[-1] in ",." and cut[-2:-1].isalpha():
                kind, word = CLOSING.index(cut[-1]) + 1, cut[:-1]
            else:
                kind, word = 0, cut
            base.append(number(word))
            tail.append(kind)
        words, self.words.fresh = self.words.fresh, []
        plain = [word[1:] if word[0] == "\0" else " " + word for word in words]
        found = self._of_words(plain)
        self.of_word.add(
            np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64)
        )
        base, tail = np.asarray(base), np.asarray(tail)
        size = self.of_word.size[base]
        ids = np.zeros(int((size + (tail > 0)).sum()), np.uint32)
        begin = np.cumsum(size + (tail > 0)) - size - (tail > 0)
        ids[spans(begin, size)] = self.of_word.pool[spans(self.of_word.begin[base], size)]
        closed = tail > 0
        ids[(begin + size)[closed]] = self.closing[tail[closed] - 1]
        self.of_cut.add(ids, size + closed)
        first = len(self.cuts) - len(fresh)
        self.of_cut.size[first : first + len(fresh)][tail < 0] = -1


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


class _Spans:
    """Growing arrays: entry i is pool[begin[i] : begin[i] + size[i]]."""

    def __init__(self) -> None:
        self.count = self.used = 0
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        end = self.count + len(sizes)
        while end > len(self.begin):
            self.begin = np.resize(self.begin, 2 * len(self.begin))
            self.size = np.resize(self.size, 2 * len(self.size))
        while self.used + len(values) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(values)] = values
        self.begin[self.count : end] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : end] = sizes
        self.count, self.used = end, self.used + len(values)


def _unsafe(cut: str) -> bool:
    """True if a text with this cut has spacing whose boundaries are not certain."""
    body = cut[1:] if cut[:1] == "\0" else cut
    return not body or body[0].isspace() or body[-1].isspace() or "\0" in body


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[i], begin[i]+1, ... of all spans, one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(begin - ends + size, size)


LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; kept between tasks of one Python worker."""
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
