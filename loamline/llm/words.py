"""Words of many texts at once, as 64-bit hashes, in numpy.

Texts are handled as UTF-8 bytes. A table says of each byte which byte is hashed for it, and whether it belongs to words;
bytes from 0x80 on always do, so that classes of ASCII characters mean the same on bytes and code points.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ByteTable:
    """low: the byte that stands for each byte; inside: whether it belongs to words."""

    low: np.ndarray
    inside: np.ndarray


def byte_table(is_word, **same: str) -> ByteTable:
    """is_word: says of an ASCII code, A-Z lower-cased already, whether it belongs to words. same: by a character's name c0 to c9, characters told as it."""
    low = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
    inside = np.array([c >= 128 or bool(is_word(int(c))) for c in low])
    for name, others in same.items():
        low[[ord(c) for c in others]] = ord(name[1:])
    return ByteTable(low, inside)


#: Words are runs of anything but ASCII white space.
SPACED = byte_table(lambda c: c != 32 and not 9 <= c <= 13)
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = byte_table(lambda c: 48 <= c <= 57 or 97 <= c <= 122)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[key] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of the texts first .. first + n - 1 of an array. at: where each text's words begin, n + 1 entries."""

    first: int
    n: int
    hashes: np.ndarray
    at: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(texts: pa.Array, table: ByteTable) -> Iterator[Words]:
    data, offsets = text_bytes(texts)
    for i, j in chunks(offsets):
        raw, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        low = table.low[raw]
        lists = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for found in _pieces(low, table, raw, off):
            for x, y in zip(lists, found, strict=True):
                x.append(y)
        starts, ends, hashes = (np.concatenate(x) if len(x) != 2 else x[1] for x in lists)
        del lists
        yield Words(i, j - i, hashes, np.searchsorted(starts, off), low, starts, ends)


def _pieces(low: np.ndarray, table: ByteTable, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and hashes of the words, for each CHUNK_BYTES of a long text, so that what a byte needs meanwhile is needed for one piece only.

    A word's hash is of the sum of its bytes' codes times powers; a word that a piece's end cuts is carried on as its start and sum.
    """
    open_at, open_sum = -1, 0
    for lo in range(0, len(raw), CHUNK_BYTES):
        hi = min(len(raw), lo + CHUNK_BYTES)
        n = hi - lo
        inside = table.inside[raw[lo:hi]]
        first = np.zeros(n, bool)  # where a text begins
        begins = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)]
        first[begins - lo] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | first))
        if open_at >= 0:  # the open word goes on
            starts = starts[starts > 0]
        last = np.zeros(n, bool)  # where a word's last byte is, as far as the piece tells
        last[:-1] = ~inside[1:] | first[1:]
        last[-1] = np.searchsorted(off, hi, "right") > np.searchsorted(off, hi) or not table.inside[raw[hi]]
        ends = np.flatnonzero(inside & last) + 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[low[lo:hi]] * up[:n], out=sums[1:])
        at = (starts if open_at < 0 else np.concatenate([[0], starts]))[: len(ends)]
        total = (sums[ends] - sums[at]) * down[at]
        begin = at + lo
        if open_at >= 0:
            so_far = pow(_BASE, lo - open_at, 1 << 64)
            if len(ends):
                total[0] = (open_sum + so_far * int(total[0])) & _MASK
                begin[0] = open_at
            else:
                open_sum = (open_sum + so_far * int(sums[n])) & _MASK
        size = (ends + lo - begin).astype(np.uint64)
        if len(ends):
            yield begin.astype(np.int32), (ends + lo).astype(np.int32), mixed(total + size * _LENGTH)
        if inside[-1] and not last[-1]:  # the last word goes on
            if open_at < 0 or len(ends):
                open_at = int(starts[-1]) + lo
                open_sum = (int(sums[n]) - int(sums[starts[-1]])) * int(down[starts[-1]]) & _MASK
        else:
            open_at = -1


_STEPS = mixed(np.arange(11, 75, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, regardless of where texts end: entry i is of words i .. i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (k * 0x8CB92BA72F3D8DD7) & _MASK, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _STEPS[j]
    return mixed(total)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of a text's k-word shingles, ascending; with fewer words, the whole sequence as one; without words, none."""
    if not len(hashes):
        return hashes
    return np.unique(sequence_hash(hashes, min(k, len(hashes))))
