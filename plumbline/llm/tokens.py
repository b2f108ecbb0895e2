"""Encoding whole texts with a tokenizer file, in Arrow batches.

Words repeat, so the library is asked once per distinct run of letters: Arrow splits a batch, encodes its words as a
dictionary, parts each into letters and the marks behind them, and looks the letters up among those known; unseen ones
go to the library many at a time, and the ids of all words are laid out by one gather. No word becomes a Python object
unless the library is asked for it. This holds for tokenizers that ignore case, whose pre-tokenizer drops
white space and parts letters from marks, and whose tokens mark word ends; ``test_tokens``
checks it against whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import once

KNOWN_WORDS = 1_000_000   # words a worker remembers, some 40 bytes each; beyond it starts anew
WORDS_AT_ONCE = 1_000_000
#: Letters that neither combine nor change length in lower case, and marks of which a run behind them is one word to the tokenizer.
LETTERS_AND_MARKS = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[.,;:!?]*)$"
TEXT_AT_ONCE = 8 << 20    # bytes of text laid out at once; one longer text is a batch of its own


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``begin``, one after the other."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size) + np.arange(total, dtype=kind)]


class _Known:
    """Strings and their ids; ``learn`` tells the ids of new ones: one array, where each begins, and how many it has."""

    def __init__(self, dtype: np.dtype, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self._dtype, self._learn = dtype, learn
        self.forget()

    def forget(self) -> None:
        self._keys = pa.array([], pa.string())
        self.ids, self._begin, self._size = np.empty(0, self._dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these different strings begin in ``ids``, and how many there are."""
        at = pc.index_in(keys, value_set=self._keys)
        if at.null_count:
            if len(self._keys) + at.null_count > KNOWN_WORDS:
                self.forget()
                at = pc.index_in(keys, value_set=self._keys)
            unseen = pc.is_null(at)
            new = keys.filter(unseen)
            ids, begin, size = self._learn(new.to_pylist())
            at = at.to_numpy(zero_copy_only=False).copy()
            at[unseen.to_numpy(zero_copy_only=False)] = len(self._keys) + np.arange(len(new))
            self._keys = pa.concat_arrays([self._keys, new])
            self.ids, self._begin, self._size = (np.concatenate(x) for x in ((self.ids, ids), (self._begin, begin + len(self.ids)), (self._size, size)))
        place = np.asarray(at).astype(np.int64)
        return self._begin[place], self._size[place]


class WordEncoder:
    """Whole texts to ids with the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._ends = np.array([(self._tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # Small ASCII letters pass the first two steps of most tokenizers unchanged; words are asked for once, so no cache helps.
        self._short_cut = Tokenizer.from_file(path)
        self._short_cut.normalizer = normalizers.Sequence([])
        self._short_cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self._short_cut.model._resize_cache(0)
        probe = " ".join([*ascii_lowercase, ascii_lowercase, ascii_lowercase[::-1], "the", "encoding", "ofwords"])
        if self._short_cut.encode(probe, add_special_tokens=False).ids != self._tokenizer.encode(probe, add_special_tokens=False).ids:
            self._short_cut = self._tokenizer
        self._letters, self._others = _Known(self.dtype, self._ask_letters), _Known(self.dtype, self._ask)

    def _ask(self, texts: list[str], short_cut: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        library = self._short_cut if short_cut else self._tokenizer
        ids: list[int] = []
        sizes: list[int] = []
        for i in range(0, len(texts), 20_000):
            for got in library.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False):
                found = got.ids
                ids += found
                sizes.append(len(found))
        size = np.array(sizes, np.int64)
        return np.array(ids, self.dtype), np.cumsum(size) - size, size

    def _ask_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters only end at the next word-end token, so the library takes many in one text."""
        ascii_only = np.fromiter(map(str.isascii, words), bool, len(words))
        order = np.concatenate([np.flatnonzero(ascii_only), np.flatnonzero(~ascii_only)])
        parts = []
        for some, short_cut in (([w for w in words if w.isascii()], True), ([w for w in words if not w.isascii()], False)):
            parts.append(self._ask([" ".join(some[i:i + 256]) for i in range(0, len(some), 256)], short_cut)[0])
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not mark word ends")
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], size[order] = np.concatenate([[0], ends])[:-1], np.diff(ends, prepend=0)
        return ids, begin, size

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these different words: one array, where each word begins in it, and how many it has."""
        parts = pc.extract_regex(words, LETTERS_AND_MARKS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(parts.field("letters").filter(parts.is_valid())).dictionary_encode()
        marks = parts.field("marks").filter(parts.is_valid()).dictionary_encode()
        others_begin, others_size = self._others.find(pa.concat_arrays([marks.dictionary, words.filter(pc.invert(parts.is_valid()))]))
        begin, size = self._letters.find(letters.dictionary)
        letter, mark = (x.indices.to_numpy(zero_copy_only=False) for x in (letters, marks))
        k = len(marks.dictionary)
        # Each word is two pieces: letters and marks, or another word and nothing.
        begins, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        begins[plain, 0], sizes[plain, 0] = begin[letter], size[letter]
        shift = len(self._letters.ids)
        begins[plain, 1], sizes[plain, 1] = others_begin[:k][mark] + shift, others_size[:k][mark]
        begins[~plain, 0], sizes[~plain, 0] = others_begin[k:] + shift, others_size[k:]
        table = gathered(np.concatenate([self._letters.ids, self._others.ids]), begins.reshape(-1), sizes.reshape(-1))
        total = sizes.sum(axis=1)
        return table, np.cumsum(total) - total, total

    def _layout(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        coded = words.dictionary_encode()
        table, begin, size = self._words(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        length = size[word]
        return gathered(table, begin[word], length), length

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text followed by ``end_id``, and the bounds of the texts."""
        split = pc.ascii_split_whitespace(texts)
        words, offsets = split.values, np.asarray(split.offsets, dtype=np.int64)
        parts = [self._layout(words[i:i + WORDS_AT_ONCE]) for i in range(int(offsets[0]), int(offsets[-1]), WORDS_AT_ONCE)]
        ids = np.concatenate([p[0] for p in parts] or [np.empty(0, self.dtype)])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)]))])
        ends = upto[offsets[1:] - offsets[0]]
        return np.insert(ids, ends, self.dtype.type(end_id)), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file."""
    return once(("tokenizer", path), lambda: WordEncoder(path))


def pieces_of(batches: Iterator[pa.RecordBatch], text_column: str, at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``at_once`` (or ``TEXT_AT_ONCE``) bytes of text, or one row."""
    at_once = TEXT_AT_ONCE if at_once is None else at_once
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text_column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            until = max(at + 1, int(np.searchsorted(size, before + at_once, "right")))
            yield batch.slice(at, until - at)
            at = until
