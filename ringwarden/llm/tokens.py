"""Token ids of whole texts by a public tokenizer file, with the words of earlier texts remembered.

The tokenizer drops white space and never looks across it, so a text's ids are the ids of its
words, one after the other; words end at ASCII white space. Each chunk of texts is split and its distinct words are found by
Arrow; arrays look all of them up at once. A worker keeps the packed ids of words it has seen, and when they grow too many those that
were seen again; new words that are Latin letters, with or without marks of punctuation at their end, take a short way through the same
BPE model (they need no normalisation but lower case), all others the whole tokenizer. The ids equal those of
encoding the whole text (tested).
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .support import small_batches, texts_of
from .text_arrays import chunks, mix, utf8

# Words a worker remembers, and ids of all of them.
REMEMBERED_WORDS = 1_000_000
REMEMBERED_IDS = 6_000_000
# New words given to the tokenizer at once; its working memory grows with them and stays with the worker.
LEARNED_AT_ONCE = 256

# Fixed pattern: letters that are normal as they are and have one lower-case form, then marks that make one piece.
PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[-.,!?;:*#$%&|<>()\\[\\]{}\"+=/_@~^]*)$"
# The last bytes of those letters' lower-case forms.
LAST_BYTES = range(0x9F, 0xC0)
# What fills eight bytes of which so many are a word's; no byte of UTF-8 is 0xFF.
FILLING = np.array([(1 << 64) - (1 << 8 * n) for n in range(9)], np.uint64)

ID_TYPE = np.dtype("<u4")
_encoders: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str, remembered: int = REMEMBERED_WORDS) -> Encoder:
    """One encoder for each tokenizer file, number of remembered words and Python worker."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


class Words:
    """Distinct words, numbered as they come. Those of up to 16 bytes are two integers each, found through a hash table; longer ones are in a dict."""

    def __init__(self):
        self.count = 0
        self.low, self.high = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.table = np.full(1 << 14, -1, np.int32)  # numbers; at least half of it is free
        self.long: dict[str, int] = {}

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[str]:
        long = {k: word for word, k in self.long.items()}
        for k in range(self.count):
            yield long.get(k) or (self.low[k].tobytes() + self.high[k].tobytes()).rstrip(b"\xff").decode()

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 if it is not there."""
        low, high, long = _integers(words)
        number = np.full(len(words), -1, np.int64)
        todo, place = np.arange(len(words)), self._place(low, high)
        while len(todo):
            k = self.table[place]
            same = (self.low[k] == low[todo]) & (self.high[k] == high[todo]) & (k >= 0)
            number[todo[same]] = k[same]
            on = (k >= 0) & ~same
            todo, place = todo[on], (place[on] + 1) & (len(self.table) - 1)
        number[long] = [self.long.get(word, -1) for word in _strings(words.take(pa.array(long)))]
        return number

    def add(self, words: pa.Array) -> None:
        """Number distinct words that are not there."""
        low, high, long = _integers(words)
        number = np.arange(self.count, self.count + len(words))
        self.long.update(zip(_strings(words.take(pa.array(long))), number[long].tolist()))
        self._add(low, high, np.delete(number, long))

    def only(self, kept: np.ndarray) -> Words:
        """These words, numbered anew."""
        out = Words()
        new = dict(zip(kept.tolist(), range(len(kept)))) if self.long else {}
        out.long = {word: new[k] for word, k in self.long.items() if k in new}
        out._add(self.low[kept], self.high[kept], np.delete(np.arange(len(kept)), [*out.long.values()]))
        return out

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _add(self, low: np.ndarray, high: np.ndarray, short: np.ndarray) -> None:
        first, self.count = self.count, self.count + len(low)
        self.low, self.high = _with_room(self.low, self.count), _with_room(self.high, self.count)
        self.low[first : self.count], self.high[first : self.count] = low, high
        if 2 * self.count > len(self.table):
            there = self.table[self.table >= 0]
            self.table = np.full(1 << (4 * self.count - 1).bit_length(), -1, np.int32)
            short = np.concatenate([there, short])
        place = self._place(self.low[short], self.high[short])
        while len(short):
            free = self.table[place] < 0
            self.table[place[free]] = short[free]
            left = self.table[place] != short  # another word stands there
            short, place = short[left], (place[left] + 1) & (len(self.table) - 1)


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = WhitespaceSplit()
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = [(chr(b), shown.pre_tokenize_str(chr(b))[0][0][-1]) for b in LAST_BYTES]
        vocabulary = self.whole.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known = Words()
        self.flat, self.start, self.length = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.again = np.zeros(1 << 12, bool)  # words that a later call asked for
        self.used = 0

    def _forget_rare(self) -> None:
        """Keep the words that were asked for again, unless they are most of them."""
        kept = np.flatnonzero(self.again[: len(self.known)])
        known, sizes = self.known.only(kept), self.length[kept]
        flat = _gathered(self.flat, self.start[kept], sizes)
        self._forget()
        if 2 * len(kept) <= self.remembered and 2 * len(flat) <= REMEMBERED_IDS:
            self._keep(known, sizes, flat)

    def _keep(self, words: pa.Array | Words, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Remember the ids of new words, which stand in ``flat`` one after the other; ``Words`` are all that is known."""
        first, n, used = len(self.known), len(words), self.used
        if isinstance(words, Words):
            self.known = words
        else:
            self.known.add(words)
        self.flat, self.again = _with_room(self.flat, used + len(flat)), _with_room(self.again, first + n)
        self.start, self.length = _with_room(self.start, first + n), _with_room(self.length, first + n)
        self.flat[used : used + len(flat)] = flat
        self.length[first : first + n] = sizes
        self.start[first : first + n] = used + np.cumsum(sizes) - sizes
        self.used = used + len(flat)

    def _as_bytes(self, text: str) -> str:
        """Lower-case letters as the model names their bytes."""
        if text.isascii():
            return text
        text = text.encode().decode("latin-1")
        for byte, name in self.shown:
            text = text.replace(byte, name)
        return text

    def _learn(self, words: pa.Array) -> None:
        found = pc.extract_regex(words, PLAIN)
        plain = found.is_valid()
        own, rest = words.filter(plain), words.filter(pc.invert(plain))
        if len(own):
            letters, marks = found.filter(plain).flatten()
            letters, marks = pc.utf8_lower(letters).dictionary_encode(), marks.dictionary_encode()
            number = self.known.find(letters.dictionary)
            new, old = number < 0, number[number >= 0]  # letters that stood alone before are known
            fresh = _strings(letters.dictionary.filter(pa.array(new)))
            found_ids = [self.letters.encode_batch_fast([self._as_bytes(" ".join(part))], add_special_tokens=False)[0].ids for part in _parts(fresh)]
            ids = np.fromiter(chain.from_iterable(found_ids), self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(fresh):
                raise ValueError("the tokenizer file does not mark word ends as expected")
            tails = [self.whole.encode(mark, add_special_tokens=False).ids for mark in _strings(marks.dictionary)]
            # fresh letters, known letters and marks stand in one array
            every = np.concatenate([ids, _gathered(self.flat, self.start[old], self.length[old]), np.array(sum(tails, []), self.dtype)])
            size = np.concatenate([np.diff(ends, prepend=0), self.length[old], [len(t) for t in tails]]).astype(np.int64)
            start = np.cumsum(size) - size
            place = np.empty(len(number), np.int64)
            place[new], place[~new] = np.arange(len(fresh)), len(fresh) + np.arange(len(old))
            # two stretches for each word: its letters, and the marks after them
            both = np.stack([place[letters.indices.to_numpy()], len(number) + marks.indices.to_numpy()], 1)
            self._keep(own, size[both].sum(axis=1), _gathered(every, start[both].ravel(), size[both].ravel()))
        found = [e.ids for part in _parts(_strings(rest)) for e in self.whole.encode_batch_fast(part, add_special_tokens=False)]
        self._keep(rest, np.array([len(f) for f in found], np.int64), np.fromiter(chain.from_iterable(found), self.dtype))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        number = self.known.find(coded.dictionary)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            self.again[number[number >= 0]] = True
            if len(self.known) + len(missing) > self.remembered or self.used > REMEMBERED_IDS:
                self._forget_rare()
                number = self.known.find(coded.dictionary)
                missing = np.flatnonzero(number < 0)
            new = coded.dictionary.take(pa.array(missing))
            self._learn(new)
            number[missing] = self.known.find(new)
        return number[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        number = self._numbers(split.flatten())
        size = self.length[number]
        packed = _gathered(self.flat, self.start[number], size).tobytes()
        after = np.append(0, np.cumsum(size))[np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)] * self.dtype.itemsize
        return [packed[a:b] for a, b in zip([0, *after.tolist()], after.tolist())]


def _integers(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first eight bytes of each word, the next eight, and which words are longer."""
    data, off = utf8(words)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = off[:-1], np.diff(off)
    low = eight[start] | FILLING[np.minimum(size, 8)]
    # a word of up to eight bytes may end where the data do
    high = eight[np.minimum(start + 8, len(data) - 8)] | FILLING[np.clip(size - 8, 0, 8)]
    return low, high, np.flatnonzero(size > 16)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _parts(words: list[str]) -> Iterator[list[str]]:
    for k in range(0, len(words), LEARNED_AT_ONCE):
        yield words[k : k + LEARNED_AT_ONCE]


def _with_room(values: np.ndarray, n: int) -> np.ndarray:
    if n <= len(values):
        return values
    out = np.zeros(max(n, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, *more: str, compact: bool = False, place: bool = False, remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit, the end id last) of every row of ``docs``.

    ``compact``: 16-bit ids where the vocabulary allows, as ``Encoder.dtype`` says. ``place``: adds a hash of the row, of the
    input partition and of how many equal rows came before it there, which tells copies apart and stays the same when a task runs again.
    ``remembered``: words that a worker keeps; fewer take less memory and more time, and give the same ids.

    Null text counts as empty and gives the end id alone. Repeated rows stay. Columns other than
    doc_id, text and ``more`` are not read.
    """
    small_batches(docs.sparkSession)
    rows = texts_of(docs, *more)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, remembered)
        width = enc.dtype if compact else ID_TYPE
        end = np.array([end_id], width).tobytes()
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()

        def place_of(doc_id: int | None, packed: bytes) -> int:
            row = (doc_id, zlib.crc32(packed))
            seen[row] += 1
            return zlib.crc32(f"{row}:{part}:{seen[row]}".encode())

        for batch in chunks(batches, "text"):
            ids = enc.encode(batch.column("text"))
            if width != enc.dtype:
                ids = [np.frombuffer(x, enc.dtype).astype(width).tobytes() for x in ids]
            ids = [x + end for x in ids]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([len(x) // width.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if place:
                columns.append(pa.array(list(map(place_of, batch.column("doc_id").to_pylist(), ids)), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = rows.select(*[f.name for f in kept]).schema.add("n_tokens", "long").add("ids", "binary")
    if place:
        schema = schema.add("place", "long")
    return rows.mapInArrow(encode, schema)
