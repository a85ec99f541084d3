"""Words of whole texts as numpy arrays, straight from Arrow string buffers.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes for which a 256-entry table is not
0; the table also lower-cases. Words never reach over the end of their text. Work is done in blocks
of about `BLOCK` bytes, so memory follows the block, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21

_BASE = np.uint64(0x9E6C63D0676A9A99)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_table(separators: Iterator[int] | set[int] | range) -> np.ndarray:
    """Byte to lower-cased byte, 0 for separators. Byte 0 must then be a separator or no word byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of `[^\x20\x09-\x0D]+`; NUL is a word byte, mapped to 255, which UTF-8 never holds.
SPACED = byte_table([32, *range(9, 14)])
SPACED[0] = 255
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
LETTERS = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a fixed bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each text; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the table's bytes."""
    mapped = table[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), mapped
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] |= inside[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] |= inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, mapped


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(length: int) -> list[np.ndarray]:
    if len(_powers[0]) < length:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(length, BLOCK // 4), base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def word_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: polynomial over its bytes, then mixed. Equal words, equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK // 4, "right")))
        size = int(ends[stop - 1] - base)
        powers, inverse = _power_tables(size + 1)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        part = mapped[base : base + size].astype(np.uint64)
        part *= powers[:size]
        np.cumsum(part, out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def hashed_words(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: first and last + 1 text, hashes of their words, and the words' bounds per text.

    Text first + i has the words bounds[i]:bounds[i + 1].
    """
    data, offsets = utf8(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, mapped = word_spans(part, own, table)
        yield first, last, word_hashes(mapped, starts, ends), np.searchsorted(starts, own)
        first = last
