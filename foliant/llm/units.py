"""Cutting texts into units that tokenize independently, and remembering each unit; on the bytes of a batch, in arrays.

The pre-token pattern of the byte-level vocabularies never matches across these places, so a text may be cut there and the ids of its
parts, put together, are the ids of the whole: before a space or another white space that follows a character which is none; before a
space that a character follows which is no white space; between one white space other than a space, if none is before it, and such a character; and
between an ASCII letter, digit and other sign (but the apostrophe, which begins contractions). Where a byte does not tell
by itself what its character is, nothing is cut, so a unit may be longer than need be. No unit splits a run of letters.

A unit is known by a 64-bit hash of its bytes, which come from running sums over the whole batch, and its bytes are compared with
those remembered, so no collision mistakes one unit for another. The memory is bounded: when it is full, the units met least go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Units remembered by a worker at most, and bytes and ids of remembered units at most.
MOST_UNITS, MOST_BYTES, MOST_IDS = 700_000, 16 << 20, 7_000_000
#: Bytes of texts that are worked on at once, unless a unit is longer.
CHUNK = 1 << 20

# Kinds of bytes: 0 not known by itself, 1 letter, 2 digit, 3 other sign, 4 space, 5 other white space.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0
_KIND[32], _KIND[9:14] = 4, 5
#: Bytes that begin a character which is certainly no white space.
_SOLID = (_KIND >= 1) & (_KIND <= 3)
_SOLID[39] = True
_SOLID[0xC3:0xE1], _SOLID[0xE4:0xF5] = True, True
#: [kind before * 6 + kind]: 0 no cut, 1 cut, 2 cut if what follows is certainly no white space, 3 cut if no white space is before the byte before.
_RULE = np.zeros(36, np.uint8)
for _a in range(6):
    _RULE[_a * 6 + 4] = 1 if 1 <= _a <= 3 else 2
    _RULE[_a * 6 + 5] = 1 <= _a <= 3
    for _b in (1, 2, 3):
        _RULE[_a * 6 + _b] = 3 if _a == 5 else 1 <= _a <= 3 and _a != _b

_CODE = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_MUL = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair, by running sums of a polynomial; equal bytes have equal hashes wherever they lie."""
    n = len(data)
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, CHUNK), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    up, down = _powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[np.minimum(start, max(n - 1, 0))] + (end - start).astype(np.uint64) * _MUL) if len(start) else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, where each begins, and the end). A null text has none."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts that begin at ``begins`` (each once)."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        kind = _KIND[data]
        rule = _RULE[kind[:-1] * np.uint8(6) + kind[1:]]
        solid = np.zeros(len(data), dtype=bool)
        solid[:-1] = _SOLID[data[1:]]
        # The next byte may be another text's.
        solid[begins[begins > 0] - 1] = False
        cut[1:] = (rule == 1) | ((rule == 2) & solid[1:])
        if len(lone := np.flatnonzero(rule == 3) + 1):
            first = np.zeros(len(data), dtype=bool)
            first[begins] = True
            before = kind[np.maximum(lone - 2, 0)]
            cut[lone] = first[lone - 1] | ((lone > 1) & (before >= 1) & (before <= 3))
    cut[begins] = True
    return np.flatnonzero(cut)


class _Rows:
    """An array that grows at its end."""

    def __init__(self, dtype: type, width: int = 0) -> None:
        self.n = 0
        self.all = np.zeros((1024, width) if width else 1024, dtype)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            more = np.zeros((max(self.n + len(x), len(self.all) * 3 // 2), *self.all.shape[1:]), self.all.dtype)
            more[: self.n] = self.all[: self.n]
            self.all = more
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)

    def keep(self, x: np.ndarray) -> None:
        self.all, self.n = x, len(x)


class Units:
    """Numbers for units. ``learn`` gets the texts of new units in the order of their numbers, ``kept`` the old numbers of those that stay, in the order of their new ones."""

    def __init__(self, learn: Callable[[list[str]], None], kept: Callable[[np.ndarray], None], most_units: int = MOST_UNITS, most_bytes: int = MOST_BYTES) -> None:
        self.learn, self.kept, self.most_units, self.most_bytes = learn, kept, most_units, most_bytes
        self.bits = max(4, (3 * most_units).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.used, self.start, self.length, self.bytes = _Rows(np.uint64), _Rows(np.int64), _Rows(np.int64), _Rows(np.int64), _Rows(np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, left, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(left):
            got = self.slots[at]
            some = got >= 0
            hit = some & (self.keys.all[got] == keys[left])
            out[left[hit]] = got[hit]
            on = some & ~hit
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        if 2 * self.keys.n > len(self.slots):
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            numbers = np.concatenate([self.listed, numbers])
        left, at = numbers, self._slot(self.keys.all[numbers])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    @property
    def listed(self) -> np.ndarray:
        return np.unique(self.slots[self.slots >= 0]).astype(np.int64)

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        first, length = self.keys.n, end - start
        self.start.add(self.bytes.n + np.cumsum(length) - length)
        self.bytes.add(gather(data, start, length))
        self.keys.add(keys)
        self.length.add(length)
        self.used.add(np.zeros(len(keys), np.int64))
        raw = data.tobytes()
        self.learn([raw[a:b].decode("utf-8") for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return np.arange(first, first + len(keys))

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the spans, which lie one after another from 0 to the end of ``data``."""
        keys = span_hashes(data, start, end)
        out = self._find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            some, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            got = self._add(data, start[new[first]], end[new[first]], some)
            self._insert(got)
            out[new] = got[inverse]
        # Bytes are compared; a unit that has another one's hash gets a number that nothing finds again.
        other = self.length.all[out] != end - start
        if not other.any():
            same = self.bytes.all[np.arange(len(data)) + np.repeat(self.start.all[out] - start, end - start)] == data
            if not same.all():
                other[np.searchsorted(start, np.flatnonzero(~same), "right") - 1] = True
        else:
            for i in np.flatnonzero(~other).tolist():
                other[i] = (self.bytes.all[self.start.all[out[i]] :][: end[i] - start[i]] != data[start[i] : end[i]]).any()
        if (odd := np.flatnonzero(other)).size:
            out[odd] = self._add(data, start[odd], end[odd], keys[odd])
        self.used.all[: self.used.n] += np.bincount(out, minlength=self.used.n)
        return out

    def _forget(self) -> None:
        """Half of the units stay, those that were met most; of equals, those met first."""
        listed = self.listed
        stay = np.sort(listed[np.argsort(-self.used.all[listed], kind="stable")[: self.most_units // 2]])
        stay = stay[: max(1, int(np.searchsorted(np.cumsum(self.length.all[stay]), self.most_bytes // 2)))]
        self.kept(stay)
        length = self.length.all[stay]
        self.bytes.keep(gather(self.bytes.all, self.start.all[stay], length).copy())
        self.start.keep(np.cumsum(length) - length)
        self.length.keep(length)
        self.keys.keep(self.keys.all[stay])
        self.used.keep(self.used.all[stay] // 2)
        self.slots[:] = -1
        self._insert(np.arange(len(stay)))

    def walk(self, column: pa.Array, full: Callable[[], bool] = lambda: False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, texts): the numbers of the units of all texts in order, in parts, and the text that each is from. Numbers hold until the next part."""
        data, at = text_bytes(column)
        texts = np.flatnonzero(at[1:] > at[:-1])
        begins = at[:-1][texts]
        pos, size = 0, CHUNK
        while pos < len(data):
            end = min(pos + size, len(data))
            part = data[pos:end]
            inside = begins[np.searchsorted(begins, pos) : np.searchsorted(begins, end)] - pos
            starts = unit_starts(part, inside if len(inside) and inside[0] == 0 else np.concatenate([[0], inside]))
            if end < len(data):
                # The last unit may go on.
                if len(starts) == 1:
                    size *= 2
                    continue
                part, starts = part[: starts[-1]], starts[:-1]
            numbers = self.numbers(part, starts, np.append(starts[1:], len(part)))
            yield numbers, texts[np.searchsorted(begins, starts + pos, "right") - 1]
            if self.keys.n > self.most_units or self.bytes.n > self.most_bytes or full():
                self._forget()
            pos, size = pos + len(part), CHUNK


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def by_pieces(split: Callable[[str], list], encode: Callable[[list], Iterable[bytes]]) -> Encode:
    """An ``encode`` for UnitMemory that splits units into pre-tokens; the other ``encode`` gives a pre-token's ids as little-endian unsigned 32-bit integers, once for each."""

    def run(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [split(u) for u in units]
        all_ = list(dict.fromkeys(chain.from_iterable(parts)))
        known = dict(zip(all_, encode(all_), strict=True))
        got = [known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p]) for p in parts]
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    return run


class UnitMemory:
    """ids(column): the ids of texts, through ``encode``, which gives the ids of many units one after another and how many each unit has."""

    def __init__(self, encode: Encode, most_units: int = MOST_UNITS, most_ids: int = MOST_IDS) -> None:
        self.encode, self.most_ids = encode, most_ids
        self.start, self.length, self.flat = _Rows(np.int64), _Rows(np.int64), _Rows(np.uint32)
        self.units = Units(self._learn, self._kept, most_units)

    def _learn(self, units: list[str]) -> None:
        flat, length = self.encode(units)
        self.start.add(self.flat.n + np.cumsum(length) - length)
        self.length.add(length)
        self.flat.add(flat)

    def _kept(self, stay: np.ndarray) -> None:
        length = self.length.all[stay]
        self.flat.keep(gather(self.flat.all, self.start.all[stay], length).copy())
        self.start.keep(np.cumsum(length) - length)
        self.length.keep(length)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has. A null text has none."""
        flat, per = [np.zeros(0, np.uint32)], np.zeros(len(column), np.int64)
        for numbers, texts in self.units.walk(column, lambda: self.flat.n > self.most_ids):
            length = self.length.all[numbers]
            flat.append(gather(self.flat.all, self.start.all[numbers], length))
            per += np.bincount(texts, weights=length, minlength=len(column)).astype(np.int64)
        return np.concatenate(flat), per


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] for each pair, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - length), length)] if total else flat[:0]
