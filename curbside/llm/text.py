"""Words of Arrow text columns, and token ids by way of distinct words."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Values that a worker remembers by word; about 40 MB.
KEEP = 100_000


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose texts have about `most` bytes; a longer text is a run of its own.

    When the batch is done, memory that is free again goes back to the system: a worker's small values leave gaps
    that would otherwise add up to hundreds of MB.
    """
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        yield batch.slice(a, b - a)
    return_memory()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs between ASCII white space: row offsets into the words, and the words. Null is empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        words = words.filter(pa.array(full))
    return offsets, words


def distinct(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The position of each word in the list of distinct words, and that list."""
    if not len(words):
        return np.zeros(0, np.int64), []
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs values[start:start+length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def _byte_symbols() -> dict[int, str]:
    """Characters that stand for the bytes 128 to 255 in byte-level vocabularies: printable Latin-1 stands for
    itself, the rest follow at 256 + 33 (after the 33 unprintable ones below 128) in order."""
    hidden = [b for b in range(128, 256) if b < 0xA1 or b == 0xAD]
    return {b: chr(256 + 34 + hidden.index(b)) for b in hidden}


class Recent:
    """What was put in or asked for last, `keep` values at most: when the newer half is full the older half goes.

    Forgetting changes no result, only how often a value is worked out again.
    """

    def __init__(self, keep: int = KEEP):
        self.half, self.new, self.old = max(1, keep // 2), {}, {}

    def get(self, key: str):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordEncoder:
    """Ids of a tokenizer that drops white space, found once for each distinct word.

    A word of Latin letters, with or without one closing mark, goes straight to the merges in lower case and without
    its mark; any other word goes through the whole tokenizer. What was found is kept as Arrow and NumPy columns and
    looked up for all words of a batch at once. Beyond `keep` entries those that the last batch did not use go, so
    the memory is bounded by `keep` and the words of one batch; results do not depend on it.
    """

    MARKS = ".,;:!?"
    SHORT = "^[A-Za-zÀ-ÖØ-öø-ÿß]+[.,;:!?]?$"

    def __init__(self, path: str, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.symbols = _byte_symbols()
        probe = ["Stille", "wässer,", "x.", "7"]
        if sum(self._plain(probe), []) != self._plain([" \n ".join(probe)])[0]:
            raise ValueError("this tokenizer does not drop white space")
        # the short way is taken only where it agrees with the tokenizer
        self.short = [self._merged(x) for x in ("stille", "wässeràí")] == self._plain(["Stille", "WässerÀÍ"])
        self.keys, self.start, self.size = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros(0, "<u4")
        self.marks = pa.array(list(self.MARKS), pa.string())
        self._add(self.marks.to_pylist(), self._plain(list(self.MARKS)))

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def _merged(self, body: str) -> list[int]:
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(self.symbols)
        return [x.id for x in self.tokenizer.model.tokenize(body)]

    def _add(self, keys: list[str], ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.keys = pa.concat_arrays([self.keys, pa.array(keys, pa.string())])
        self.start = np.concatenate((self.start, len(self.values) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.values = np.concatenate((self.values, np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum()))))

    def _forget(self, used: np.ndarray) -> None:
        """Leave only the marks and the entries `used`."""
        kept = np.union1d(np.arange(len(self.marks)), used)
        self.values = gather(self.start[kept], self.size[kept], self.values)
        self.keys, self.size = self.keys.take(pa.array(kept)), self.size[kept]
        self.start = np.cumsum(self.size) - self.size

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of `words`, and the ids of all, one word after another."""
        words = words.cast(pa.string())
        if self.short:
            short = pc.match_substring_regex(words, self.SHORT)
            mark = pc.utf8_slice_codeunits(words, -1, None)
            at_mark = pc.if_else(short, pc.index_in(mark, value_set=self.marks), None)
            bare = pc.if_else(pc.is_valid(at_mark), pc.utf8_slice_codeunits(words, 0, -1), words)
            keys = pc.if_else(short, pc.utf8_lower(bare), words).dictionary_encode()
            at_mark = pc.fill_null(at_mark, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            keys, at_mark = words.dictionary_encode(), np.full(len(words), -1)
        code, keys = keys.indices.to_numpy().astype(np.int64), keys.dictionary
        found = pc.index_in(keys, value_set=self.keys)
        late = keys.filter(pc.is_null(found))
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.keys) + np.arange(len(late))
        if self.short:
            letters = pc.match_substring_regex(late, self.SHORT)
            bodies = late.filter(letters).to_pylist()
            others = late.filter(pc.invert(letters)).to_pylist()
            order = np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable")
            # entries are added bodies first
            moved = np.empty(len(order), np.int64)
            moved[order] = np.arange(len(order))
            new = at >= len(self.keys)
            at[new] = len(self.keys) + moved[at[new] - len(self.keys)]
        else:
            bodies, others = [], late.to_pylist()
        self._add(bodies + others, [self._merged(x) for x in bodies] + self._plain(others))
        at = at[code]
        # two runs for each word: what its key gives, and its mark
        start = np.column_stack((self.start[at], self.start[at_mark])).ravel()
        size = np.column_stack((self.size[at], np.where(at_mark >= 0, self.size[at_mark], 0)))
        values = gather(start, size.ravel(), self.values)
        if len(self.keys) > self.keep:
            self._forget(at)
        return size.sum(axis=1), values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets into the ids, and the ids of all texts."""
        offsets, words = split_words(texts)
        if not len(words):
            return np.zeros(len(offsets), np.int64), np.zeros(0, "<u4")
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        size, values = self.words(coded.dictionary)
        lengths = size[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ends[offsets], gather((np.cumsum(size) - size)[codes], lengths, values)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        offsets, words = split_words(texts)
        coded = words.dictionary_encode()
        size, _ = self.words(coded.dictionary)
        return np.diff(np.concatenate(([0], np.cumsum(size[coded.indices.to_numpy().astype(np.int64)])))[offsets])


_RESIDENT: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What `make` gives, kept by this worker until another key is asked for.

    Only one is kept (with those that making it asks for), so the memory of operators that run one after another in a
    worker does not add up.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        return_memory()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def return_memory() -> None:
    """Give memory that Python and Arrow no longer use back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def word_encoder(path: str) -> WordEncoder:
    return resident(("words", path), lambda: WordEncoder(path))
