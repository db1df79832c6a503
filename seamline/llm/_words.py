"""Words and word windows of Arrow text batches, as arrays of 64-bit hashes.

A word is a run of bytes other than space and U+0009 to U+000D. Texts are taken from the
Arrow buffers as they are, in slices of some megabytes, and all words of a slice are hashed
at once: a word's hash is a difference of prefix sums of a polynomial in its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x + U64(salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(256, dtype=U64), 7)
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, n)
    if size not in _POWERS:
        def run(base: int) -> np.ndarray:
            out = np.full(size, U64(base))
            out[0] = 1
            return np.cumprod(out, dtype=U64)
        if size > SLICE_BYTES:  # a single very long text: not kept
            return run(_RADIX), run(_INVERSE)
        _POWERS[size] = run(_RADIX), run(_INVERSE)
    return _POWERS[size]


@dataclass
class Slice:
    """Some texts of a batch. ``first`` and ``last``: their rows; ``at``: byte offsets of the
    texts in ``data``; ``word_at``: offsets of the texts in the arrays of words."""

    first: int
    last: int
    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray
    words: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(column: pa.Array, lower: bool) -> Iterator[Slice]:
    """The words of a column's texts, slice by slice; ``lower`` folds A-Z into a-z."""
    data, at = text_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        part, ends_at = data[at[first] : at[last]], at[first : last + 1] - at[first]
        space = IS_SPACE[part]
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = ends_at[(ends_at > 0) & (ends_at < len(part))]
        before[edges], after[edges - 1] = True, True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        powers, inverses = _powers(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[part] * powers[: len(part)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U64)) if len(starts) else np.zeros(0, U64)
        yield Slice(first, last, part, ends_at, starts, ends, np.searchsorted(starts, ends_at), words)
        first = last


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; those over a text's end are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(size))
    for k in range(size):
        out = mix(out * U64(0xD6E8FEB86659FD93) + words[k : k + n])
    return out


def shingle_sets(part: Slice, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct window hashes; a shorter text gives one window of all
    its words, a text without words none."""
    full = windows(part.words, size)
    for a, b in zip(part.word_at[:-1], part.word_at[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            yield windows(part.words[a:b], int(b - a))
        else:
            yield np.zeros(0, U64)
