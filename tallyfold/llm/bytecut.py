"""Many texts cut into words at once: array operations on their UTF-8 bytes, without a Python object for each word.

Texts come as Arrow string columns, nulls as empty. ``parts`` deals a column into slices of a bounded number of bytes, so the arrays made here
stay small however many texts a batch holds; a text is never cut, so one that is longer is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a slice; the arrays made for it take some forty times as much.
SLICE = 1 << 20
#: Words are cut at ASCII white space.
BLANK = np.isin(np.arange(256), (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Hands what a task has freed back to the system: its Python worker lives on, and what that keeps adds to the next task's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end of the last."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[begin[0] : begin[-1]], begin - begin[0]


def parts(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, end) of slices that hold at most ``most`` bytes, or one text."""
    _, begin = flat(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + most, "right")) - 1)
        yield at, end
        at = end


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed random-looking 64-bit number for each number."""
    x = (x + np.uint64(1)) * MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each of the first places of a word; beyond, they are computed.
FRONT = 48
NUMBERS = scrambled(np.arange(FRONT * 256, dtype=np.uint64))


def begins(inside: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which of the bytes marked as ``inside`` a word begin one: after one that isn't, or where a text begins."""
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = begin[:-1][begin[:-1] < len(inside)]
    new[first] = inside[first]
    return new


@dataclass(frozen=True)
class Words:
    """The words of some texts, A-Z lower-cased: ``hashes``, where each text's ``begin`` among them, with the end, and the bytes of its text at which each
    word starts (``at``) and ends (``end``)."""

    hashes: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    end: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    @property
    def left(self) -> np.ndarray:
        """How many words each text has from each word on."""
        return np.repeat(self.begin[1:], np.diff(self.begin)) - np.arange(len(self.hashes))


def words(column: pa.Array) -> Words:
    """A word's hash is the sum of one number for each byte and its place, scrambled to 64 bits."""
    data, begin = flat(column)
    inside = ~BLANK[data]
    new = begins(inside, begin)
    at = np.flatnonzero(new)
    if not len(at):
        return Words(np.empty(0, np.uint64), np.zeros(len(begin), np.int64), at, at)
    starts, low = np.flatnonzero(new[inside]), LOWER[data[inside]]
    sizes = np.diff(np.append(starts, len(low)))
    place = np.arange(len(low), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    key = (place << 8) | low
    numbers = NUMBERS[np.minimum(key, len(NUMBERS) - 1)]
    far = np.flatnonzero(place >= FRONT)
    if len(far):
        numbers[far] = scrambled((place[far].astype(np.uint64) << np.uint64(8)) + low[far])
    first = np.searchsorted(at, begin)
    at = at - np.repeat(begin[:-1], np.diff(first))
    return Words(scrambled(np.add.reduceat(numbers, starts)), first, at, at + sizes)


def sliced(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end, words) of slices of bounded size."""
    for at, end in parts(column):
        yield at, end, words(column.slice(at, end - at))


def hashed(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column, in turn."""
    for _, _, w in sliced(column):
        yield from (w.hashes[a:b] for a, b in zip(w.begin[:-1].tolist(), w.begin[1:].tolist(), strict=True))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter, none if it is empty. Runs of any length come from doubling ones."""
    k = min(k, len(hashes))
    if not k:
        return hashes
    out, size, double, span = None, 0, hashes, 1
    while True:
        if k & span:
            out = double if out is None else scrambled(out[: len(hashes) - size - span + 1] * MIX + double[size:])
            size += span
        if size == k:
            return out
        double, span = scrambled(double[: len(hashes) - 2 * span + 1] * MIX + double[span:]), 2 * span


def extreme(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or largest of each ``width`` neighbours; pick is np.minimum or np.maximum."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values, span = pick(values[:-step], values[step:]), span + step
    return values
