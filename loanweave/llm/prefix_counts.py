"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For each prefix of a word there is exactly one token that can end its encoding: the one that fits
the last token of the prefix before it. Two tokens fit when the vocabulary's merges, run on both
together, give these two again. So one pass over a word's places yields the count of every prefix:
count[end] = count[start] + 1 for the only token from start to end that fits. Counts of words add
up along a text. A prefix that ends inside white space is a run of its own: where the pattern
splits a run (its last space belongs to the next word), the count there is that of the whole run.

A table of prefixes holds, per text, the steps from each prefix's count to the next, in 4, 8, 16 or
32 bits each. Truncation and budget questions are answered from it, without the text.

Distinct pieces of text are counted once and kept in a bounded cache, since corpora repeat words.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch
from loanweave.llm.tokens import CLOSING, LETTERS, spans, vocabulary_path

PREFIXES = "doc_id long, n_bytes long, n_chars long, n_tokens long, width int, steps binary"
TEXTS_PER_CALL = 64
PIECE = 1 << 18  # characters of a long text handled at once
KEPT_CHARS = 12_000_000  # characters of distinct pieces kept per worker; beyond it the cache starts anew
KEPT_PAIRS = 500_000
LONG_WORD = 256  # characters; longer words are counted but not kept
SHORT_WORD = 48  # bytes; words up to this length are counted many at once
WORDS_PER_CALL = 8192
PAIR_SLOTS = 1 << 20  # a pair of tokens has one slot; a later pair may take it over
SPACE = chr(LETTERS[ord(" ")])  # the letter that stands for a space
#: A place that is a word boundary in any text: a single space between two other characters.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """``text`` cut before single spaces between other characters, every ``limit`` characters or
    as soon after as there is one; a later piece begins with its space."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class PrefixCounter:
    """Token counts of all prefixes, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words_of = self.library.pre_tokenizer.pre_tokenize_str
        self.tokenize = self.library.model.tokenize
        added = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that take neighbouring characters along are not supported")
        self.special = re.compile("|".join(
            re.escape(t.content) for t in sorted(added.values(), key=lambda t: -len(t.content))
        ) or r"(?!)")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.name = [""] * (max(vocabulary.values()) + 1)
        # A tree of the tokens' letters: letter -> [id of the token that ends here or -1, subtree].
        leaf: dict[str, list] = {}
        self.tree: dict[str, list] = {}
        for token, number in vocabulary.items():
            self.name[number] = token
            node = self.tree
            for letter in token[:-1]:
                entry = node.setdefault(letter, [-1, leaf])
                if entry[1] is leaf:
                    entry[1] = {}
                node = entry[1]
            node.setdefault(token[-1], [-1, leaf])[0] = number
        self._flatten()
        self.slot_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.slot_good = np.zeros(PAIR_SLOTS, bool)
        self.fitting: dict[int, dict[int, bool]] = {}
        self.known_pairs = 0
        self._start_anew()

    def _start_anew(self) -> None:
        self.kept = 0
        self.number: dict[str, int] = {}
        self.begin, self.size = array("q"), array("q")  # size -1: not a safe piece
        self.pool = array("h")
        self.words: dict[str, array] = {}
        self.lettered: dict[str, array] = {}

    def _flatten(self) -> None:
        """The tree as tables over (inner node, byte): the token that ends there, the next node."""
        byte_of = {chr(letter): byte for byte, letter in LETTERS.items()}
        inner, cells = [self.tree], []
        for number, node in enumerate(inner):  # grows while it is walked
            for letter, (token, below) in node.items():
                cells.append((number * 256 + byte_of[letter], token, len(inner) if below else -1))
                if below:
                    inner.append(below)
        place, token, below = np.array(cells, np.int64).T
        self.token_at = np.full(256 * len(inner), -1, np.int32)
        self.node_at = np.full(256 * len(inner), -1, np.int32)
        self.token_at[place], self.node_at[place] = token, below

    def _merged(self, first: int, second: int) -> bool:
        """Whether the merges, run on both tokens together, give these two again."""
        found = self.tokenize(self.name[first] + self.name[second])
        return len(found) == 2 and found[0].id == first and found[1].id == second

    def _fit_all(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``_merged`` of many pairs; a negative first token fits any."""
        key = first.astype(np.int64) << 32 | second
        slot = (key * 0x1E3779B97F4A7C15 >> 40) % PAIR_SLOTS
        good = self.slot_good[slot]
        unknown = np.flatnonzero((self.slot_key[slot] != key) & (first >= 0))
        if len(unknown):
            fresh, place = np.unique(key[unknown], return_inverse=True)
            value = np.array([self._merged(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], bool)
            good[unknown] = value[place]
            # Only one of two pairs that share a slot may stay, with its own value.
            taken, which = np.unique(slot[unknown], return_index=True)
            self.slot_key[taken] = key[unknown[which]]
            self.slot_good[taken] = good[unknown[which]]
        return good | (first < 0)

    def counts_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at prefixes of 0, 1, ... bytes of many short words, a row each, all of them found
        place by place; and which word each row belongs to."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")  # the words that reach a place come first
        size, width = length[order], int(length.max(initial=0))
        rows = np.zeros((len(words), width), np.uint8)
        rows[np.arange(width) < size[:, None]] = np.frombuffer(
            b"".join([words[i] for i in order]), np.uint8)
        last = np.full((len(words), width + 1), -1, np.int32)
        count = np.zeros((len(words), width + 1), np.int16)
        for start in range(width):
            at = np.arange(np.searchsorted(-size, -start))  # longer than start
            node = np.zeros(len(at), np.int64)
            for end in range(start + 1, width + 1):
                cell = node * 256 + rows[at, end - 1]
                token = self.token_at[cell]
                open_ = np.flatnonzero((token >= 0) & (count[at, end] == 0))
                word, token = at[open_], token[open_]
                good = self._fit_all(last[word, start], token)
                word, token = word[good], token[good]
                last[word, end], count[word, end] = token, count[word, start] + 1
                node = self.node_at[cell]
                going = (node >= 0) & (size[at] > end)
                at, node = at[going], node[going].astype(np.int64)
                if not len(at):
                    break
        return count, order

    def learn(self, texts: Sequence[str]) -> None:
        """Find the steps of the texts' new plain words, many at once."""
        if self.kept > KEPT_CHARS:
            self._start_anew()
        fresh: set[str] = set()
        for text in texts:
            for piece in pieces(text):
                for part in set(self._parts(piece)).difference(self.number):
                    first, _, core = self._core(part)
                    word = core if first else " " + core
                    if _plain_letters(core) and word not in self.words and len(word) <= SHORT_WORD // 2:
                        fresh.add(word)
                if len(fresh) >= WORDS_PER_CALL:
                    self._learn_words(fresh)
                    fresh = set()
        if fresh:
            self._learn_words(fresh)

    def _learn_words(self, fresh: set[str]) -> None:
        words = list(fresh)
        raw = [w.encode() for w in words]
        counts, order = self.counts_of(raw)
        steps, wide = np.diff(counts, axis=1).tobytes(), 2 * (counts.shape[1] - 1)
        for row, i in enumerate(order.tolist()):
            word, data = words[i], raw[i]
            if len(data) == len(word):
                self.words[word] = array("h", steps[row * wide : row * wide + 2 * len(data)])
            else:  # characters of several bytes: their last one counts
                self.words[word] = _per_character(counts[row, 1 : len(data) + 1].tolist(), data)
            self.kept += len(word) + 8

    def _fits(self, first: int, second: int) -> bool:
        good = self._merged(first, second)
        if self.known_pairs >= KEPT_PAIRS:
            self.fitting.clear()
            self.known_pairs = 0
        self.fitting.setdefault(first, {})[second] = good
        self.known_pairs += 1
        return good

    def letter_counts(self, word: str) -> Sequence[int]:
        """Counts of all prefixes of one word of the pattern, written in byte letters."""
        n, tree, fitting, unseen = len(word), self.tree, self.fitting, {}
        if n > LONG_WORD:
            last, count = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        else:
            last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, following, node = last[start], count[start] + 1, tree
            known = fitting.get(before, unseen)
            for end, letter in enumerate(word[start:] if start else word, start + 1):
                entry = node.get(letter)
                if entry is None:
                    break
                token, node = entry
                if token >= 0 and not count[end]:
                    good = before < 0 or known.get(token)
                    if good is None:
                        good = self._fits(before, token)
                    if good:
                        last[end], count[end] = token, following
        return count[1:]

    def _plain(self, text: str) -> np.ndarray:
        """Steps per character of a text in which no special token counts."""
        out, before = [], None
        fix_at, fix_by, at = [], [], 0
        for letters, (begin, end) in self.words_of(text):
            counts = self.letter_counts(letters)
            word = text[begin:end]
            if len(letters) != end - begin:  # characters of several bytes
                sizes = np.fromiter((len(c.encode()) for c in word), np.int64, len(word))
                counts = np.asarray(counts, np.int32)[np.cumsum(sizes) - 1]
            else:
                counts = np.asarray(counts, np.int32)
            if before is not None and before[-1].isspace() and word[0].isspace():
                run = self.library.encode(before + word[0], add_special_tokens=False)
                fix_at.append(at)
                fix_by.append(len(run.ids) - (int(out[-1][-1]) + int(counts[0])))
            out.append(counts)
            before, at = word, at + len(word)
        if not out:
            return np.zeros(0, np.int32)
        steps = np.concatenate([np.diff(c, prepend=0) for c in out])
        for place, by in zip(fix_at, fix_by):
            steps[place] += by
            if place + 1 < len(steps):
                steps[place + 1] -= by
        return steps

    def _whole(self, text: str) -> np.ndarray:
        """Steps of any text. Up to its last character a special string is ordinary text; with it
        the whole string is one token."""
        out, at = [], 0
        for found in self.special.finditer(text):
            steps = self._plain(text[at : found.end() - 1])
            ordinary = found.start() - at
            out += [steps, np.array([1 - int(steps[ordinary:].sum())], np.int32)]
            at = found.end()
        out.append(self._plain(text[at:]))
        return np.concatenate(out)

    def _word(self, word: str) -> array:
        """Steps of Latin letters with at most one space before them: one word of the pattern."""
        steps = self.words.get(word)
        if steps is None:
            if word.isascii():
                letters = word.replace(" ", SPACE)
            else:
                letters = word.encode().decode("latin-1").translate(LETTERS)
            steps = self.words[word] = self._steps(letters, word)
            self.kept += len(word) + 8
        return steps

    def _steps(self, letters: str, word: str) -> array:
        """Steps per character of one word of the pattern, given in byte letters too."""
        return _per_character(self.letter_counts(letters), word.encode())

    def _cut(self, text: str) -> array:
        """Steps of a text without white space but for one space before it: its words, each found
        once, one after another."""
        found = array("h")
        for letters, (begin, end) in self.words_of(text):
            steps = self.lettered.get(letters)
            if steps is None:
                steps = self.lettered[letters] = self._steps(letters, text[begin:end])
                self.kept += len(letters) + 8
            found.extend(steps)
        return found

    @staticmethod
    def _core(part: str) -> tuple[bool, str, str]:
        """Whether a cut stands without a space, its text, and that without a closing mark."""
        first = part[:1] == "\0"
        body = part[1:] if first else part
        return first, body, body[:-1] if body[-1:] in CLOSING and body[-2:-1].isalpha() else body

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The cuts of a text; those that follow no space begin with a zero character."""
        parts = text.replace("\n", " \n \0").split(" ")
        if text[:1] == " ":
            return parts[1:]
        parts[0] = "\0" + parts[0]
        return parts

    def _numbered(self, part: str) -> int:
        """Number of a cut; ``part`` follows a space unless it begins with a zero character."""
        number = self.number[part] = len(self.size)
        begin = len(self.pool)
        self.begin.append(begin)
        first, body, core = self._core(part)
        self.kept += len(part) + 8
        if _plain_letters(core):
            self.pool.extend(self._word(core if first else " " + core))
            if len(core) < len(body):
                self.pool.append(1)
        elif part == "\n" or body and not body[0].isspace() and not body[-1].isspace():
            if len(body.split()) == 1:
                self.pool.extend(self._cut(body if first else " " + body))
            else:
                steps = self._plain(part if part == "\n" else body if first else " " + body)
                self.pool.frombytes(steps.astype(np.int16).tobytes())  # at most LONG_WORD characters
        else:
            self.size.append(-1)
            return number
        self.size.append(len(self.pool) - begin)
        return number

    def _piece(self, text: str) -> np.ndarray:
        """Steps of a text that holds no special string, from its cuts where these are safe."""
        if "\0" in text:  # it marks cuts without a space
            return self._plain(text)
        parts = self._parts(text)
        if max(map(len, parts)) > LONG_WORD:
            return self._plain(text)
        if self.kept > KEPT_CHARS:
            self._start_anew()
        known, numbered = self.number.get, self._numbered
        number = np.fromiter(
            [numbered(p) if (k := known(p)) is None else k for p in parts], np.int64, len(parts)
        )
        size = np.frombuffer(self.size, np.int64)[number]
        if size.min() < 0:
            return self._plain(text)
        begin = np.frombuffer(self.begin, np.int64)[number]
        return np.frombuffer(self.pool, np.int16)[spans(begin, size)]

    def steps(self, text: str) -> np.ndarray:
        """For each character, how many more tokens the text has with it than up to it."""
        if not text:
            return np.zeros(0, np.int16)
        if self.special.search(text):
            return self._whole(text)
        found = [self._piece(p) for p in pieces(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)


def _per_character(counts: Sequence[int], data: bytes) -> array:
    """Steps per character from counts per byte: a character's last byte counts."""
    counts = [n for n, byte in zip(counts, data[1:] + b"a") if byte & 0xC0 != 0x80]
    return array("h", map(sub, counts, [0, *counts]))


def _plain_letters(word: str) -> bool:
    """Latin letters alone, which are one word of the pattern."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """The worker's counter; kept between tasks of one Python worker."""
    return PrefixCounter(path)


def pack(steps: np.ndarray) -> tuple[int, bytes]:
    """(bits per step, bytes): the narrowest of 4, 8, 16, 32 bits that holds every step."""
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    if -8 <= low and high < 8:
        nibbles = np.zeros(len(steps) + len(steps) % 2, np.uint8)
        nibbles[: len(steps)] = steps & 15
        return 4, (nibbles[::2] | nibbles[1::2] << 4).tobytes()
    width = next(w for w in (8, 16, 32) if -(1 << w - 1) <= low and high < 1 << w - 1)
    return width, steps.astype(f"<i{width // 8}").tobytes()


def unpack(width: int, data: bytes, n_chars: int) -> np.ndarray:
    """Counts at the prefixes of 0 to ``n_chars`` characters."""
    if width == 4:
        both = np.frombuffer(data, np.uint8)
        steps = np.stack([both & 15, both >> 4], 1).reshape(-1)[:n_chars].astype(np.int8)
        steps = np.where(steps > 7, steps - 16, steps)
    else:
        steps = np.frombuffer(data, f"<i{width // 8}")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefix_table(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_chars, n_tokens and the packed steps.

    Texts are whole; a null or empty one has no prefixes but the empty one. Null and repeated ids
    keep their rows. Only doc_id and text are read; no rows give none.
    """
    schema, path = arrow_schema(PREFIXES), vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CALL):
                rows = batch.slice(at, TEXTS_PER_CALL)
                texts = rows.column(1).to_pylist()
                words.learn(texts)
                found = [words.steps(t) for t in texts]
                packed = [pack(s) for s in found]
                yield record_batch(
                    [rows.column(0), rows.column(2), [len(s) for s in found],
                     [int(s.sum(dtype=np.int64)) for s in found],
                     [w for w, _ in packed], [b for _, b in packed]], schema,
                )

    text = F.coalesce("text", F.lit(""))
    rows = for_tasks(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(run, PREFIXES)


def answers(prefixes: DataFrame, budgets: Sequence[int] = (), cuts: Sequence[int] = ()) -> DataFrame:
    """From a prefix table alone: doc_id, n_bytes, n_tokens; ``fits`` holds per budget the
    characters of the longest prefix with at most so many tokens, ``counts`` per cut the tokens of
    the first so many characters (of the whole text, if it is shorter)."""
    budgets, cuts = list(budgets), list(cuts)
    ddl = "doc_id long, n_bytes long, n_tokens long, fits array<long>, counts array<long>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, counts = [], []
            sizes, widths, data, tokens = (
                batch.column(c).to_pylist() for c in ("n_chars", "width", "steps", "n_tokens"))
            for n, width, steps, total in zip(sizes, widths, data, tokens):
                if not cuts and all(total <= b for b in budgets):  # the whole text fits
                    fits.append([n] * len(budgets))
                    counts.append([])
                    continue
                at = unpack(width, steps, n)
                fits.append([int(np.flatnonzero(at <= b)[-1]) if b >= 0 else None for b in budgets])
                counts.append([int(at[min(max(c, 0), n)]) for c in cuts])
            yield record_batch([*(batch.column(c) for c in ("doc_id", "n_bytes", "n_tokens")), fits, counts], schema)

    return for_tasks(prefixes).mapInArrow(run, ddl)
