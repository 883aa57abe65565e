"""Token ids of whole texts by a byte-level BPE file, a batch of texts at a time.

A byte-level tokenizer never joins what one space or line end between two other signs separates.
So the bytes of a batch are cut there into units (each with the white space in front), the units are made
distinct by Arrow, and only units not met before go to the tokenizer.  The ids of all texts are
then one gather from the pool of remembered ids; Python touches distinct units, not words.
"""

from __future__ import annotations

import os
from codecs import charmap_decode
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Units whose ids a Python worker remembers; beyond, it starts anew (some 150 bytes a unit).
MAX_REMEMBERED = 1_000_000
#: Longer units are encoded each time they come.
MAX_UNIT = 64

_BYTES = np.arange(256)
_LETTER = np.isin(_BYTES, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
# Visible ASCII but letters, digits and the apostrophe, which may open a contraction.
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~((_BYTES >= 48) & (_BYTES < 58)) & (_BYTES != 39)
_BLANK = (_BYTES == 32) | (_BYTES == 10)
# First bytes that white space shares with other signs.
_UNSURE = (_BYTES == 0xC2) | ((_BYTES >= 0xE1) & (_BYTES <= 0xE3))


def _byte_signs() -> str:
    """The signs that stand for bytes in byte-level vocabularies: themselves if visible, else from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return "".join(chr(b if b in visible else 256 + hidden.index(b)) for b in range(256))


_BYTE_SIGNS = _byte_signs()


@dataclass
class Encoded:
    """The ids of some texts in one array; text i has ``ids[starts[i]:starts[i + 1]]``."""

    ids: np.ndarray
    starts: np.ndarray

    def ended(self, end: int) -> Encoded:
        """Every text's ids with ``end`` behind them, as little-endian unsigned 32-bit integers."""
        ids = np.insert(self.ids, self.starts[1:], end).astype("<u4", copy=False)
        return Encoded(ids, self.starts + np.arange(len(self.starts)))


def _c3(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two bytes that are a letter, C3 and another."""
    return (first == 0xC3) & (second != 0x97) & (second != 0xB7)


def unit_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts that begin at ``texts`` (its last entry is the end).

    A unit begins with each text; at every space and on both sides of every line end that stands alone
    between two signs that are surely not white space (signs whose first byte white space shares are
    not sure); and between ASCII punctuation and a letter that is ASCII or C3 and a byte, in either order.
    """
    at = np.flatnonzero((_SIGN | _BLANK)[data])
    at = at[(at > 0) & (at < len(data) - 2)]
    sign, before, second, after = data[at], data[at - 1], data[np.maximum(at - 2, 0)], data[at + 1]

    sure = (after > 32) & ~_UNSURE[after] & (before > 32)
    sure &= (before < 0x80) | ~(_UNSURE[second] | _UNSURE[data[np.maximum(at - 3, 0)]])
    blank = at[sure & _BLANK[sign]]
    lines = blank[data[blank] == 10] + 1

    follows = _SIGN[sign] & (_LETTER[before] | _c3(second, before))
    leads = _SIGN[sign] & (_LETTER[after] | _c3(after, data[at + 2]))
    found = np.concatenate([blank, lines, at[follows], at[leads] + 1, texts])
    return np.sort(found, kind="stable")


class Encoder:
    """Ids of texts; a text that holds an added token goes to the tokenizer whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same pieces without the splitting of texts, for what is one piece of a text already.
        self.words = Tokenizer(self.tokenizer.model)
        size = self.tokenizer.get_vocab_size()
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)  # ids of entry i: pool[bounds[i]:bounds[i + 1]]
        self.entries = 0

    def _tokenize(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, units: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, last = int(self.bounds[self.entries]), self.entries + len(units)
        while len(self.bounds) <= last:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.bounds[self.entries + 1 : last + 1] = first + np.cumsum(sizes)
        end = first + len(flat)
        while len(self.pool) < end:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[first:end] = flat
        self.known.update(zip(units, range(self.entries, last)))
        self.entries = last

    def _learn(self, units: list[bytes]) -> None:
        """Remember the ids of units; a space and letters are one piece for the tokenizer."""
        words, rest = [], []
        for unit in units:
            (words if unit.decode().removeprefix(" ").isalpha() else rest).append(unit)
        if words:
            signs = charmap_decode(b"\0".join(words), "strict", _BYTE_SIGNS)[0].split(_BYTE_SIGNS[0])
            found = self.words.encode_batch_fast([signs], is_pretokenized=True, add_special_tokens=False)
            flat = np.array(found[0].ids, np.uint32)
            # Every sign stands for a byte, so the ids of a word are those that fill its bytes.
            filled = np.cumsum(self.width[flat])
            last = np.searchsorted(filled, np.cumsum([len(w) for w in words]))
            self._remember(words, flat, np.diff(last + 1, prepend=0))
        if rest:
            ids = self._tokenize([u.decode() for u in rest])
            self._remember(
                rest, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
            )

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of a string array (null counts as empty), without end signs."""
        texts = texts.fill_null("").cast(pa.large_string())
        count = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
        if not count or offsets[0] == offsets[-1]:
            return Encoded(np.zeros(0, np.uint32), np.zeros(count + 1, np.int64))
        buffer = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        data = np.frombuffer(buffer, np.uint8)
        starts = unit_starts(data, offsets)
        units = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), buffer]
        )
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if self.entries > MAX_REMEMBERED:
            self._forget()
        entry = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(entry < 0)
        new = distinct[missing].tolist()
        long = [u for u in new if len(u) > MAX_UNIT]
        self._learn([u for u in new if len(u) <= MAX_UNIT])
        before = self.entries
        self._learn(long)
        entry[missing] = np.fromiter(map(self.known.get, new), np.int64, len(new))
        first, size = self.bounds[entry], self.bounds[entry + 1] - self.bounds[entry]
        codes = coded.indices.to_numpy()
        sizes = size[codes]
        ends = np.cumsum(sizes)
        places = np.repeat(first[codes] - (ends - sizes), sizes)
        places += np.arange(len(places))
        ids = self.pool[places]
        bounds = np.concatenate([[0], ends])
        result = Encoded(ids, bounds[np.searchsorted(starts, offsets, side="left")])
        for unit in long:
            del self.known[unit]
        self.entries = before
        whole = self._with_added(buffer, offsets)
        return self._replaced(result, whole, texts) if len(whole) else result

    def _with_added(self, buffer: pa.Buffer, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold an added token."""
        found = set()
        view = buffer.to_pybytes() if self.added else b""
        for token in self.added:
            at = view.find(token)
            while at >= 0:
                number = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[number + 1]:
                    found.add(number)
                at = view.find(token, at + 1)
        return np.array(sorted(found), np.int64)

    def _replaced(self, result: Encoded, numbers: np.ndarray, texts: pa.Array) -> Encoded:
        parts = [result.ids[a:b] for a, b in zip(result.starts[:-1], result.starts[1:])]
        for number, ids in zip(numbers, self._tokenize([texts[int(n)].as_py() for n in numbers])):
            parts[number] = np.array(ids, np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return Encoded(np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The Python worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
