"""Word shingles of whole texts as 64-bit numbers, computed over the bytes of many texts at once.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case.  A word's number mixes
its bytes, eight at a time, into its length; a word of up to eight bytes has a number that no other such
word of its length has.  Long words get their number from BLAKE2.  A shingle's number folds the numbers
of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK_BYTES = 1 << 20
#: Bytes mixed at a time, and the longest word that is mixed so.
LANE, LONG_WORD = 8, 64
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(LANE + 1)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit changes about half of the output."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_numbers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of a block of texts, and the number of words of each text.

    ``data`` holds the bytes, ``bounds`` the len(texts) + 1 places where texts begin and end.
    """
    solid = ~GAP[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lower = np.zeros(len(data) + LANE, np.uint8)
    lower[: len(data)] = LOWER[data]
    lanes = np.ndarray(len(data), np.dtype("<u8"), lower, strides=(1,))  # eight bytes from each place on
    size = stop - start
    numbers = mix(size.astype(np.uint64))
    left = np.arange(len(start))
    for at in range(0, min(LONG_WORD, int(size.max(initial=0))), LANE):
        left = left[size[left] > at]
        numbers[left] = mix(numbers[left] * MIX_A + (lanes[start[left] + at] & MASKS[np.minimum(size[left] - at, LANE)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        numbers[i] = int.from_bytes(hashlib.blake2b(lower[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    words = np.diff(np.searchsorted(start, bounds))
    return numbers, words


def folded(numbers: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """One number for each run of ``length`` words that begins at one of the places ``first``."""
    out = np.full(len(first), np.uint64(length))
    for j in range(length):
        out = mix(out * MIX_A + numbers[first + j])
    return out


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle numbers (uint64).

    A text with fewer words has one shingle, the whole sequence; a null or wordless text has none.
    """
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    low, empty = 0, np.zeros(0, np.uint64)
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, "right")) - 1)
        bounds = offsets[low : high + 1]
        if bounds[-1] == bounds[0]:
            yield from (empty for _ in range(low, high))
        else:
            numbers, counts = word_numbers(body[bounds[0] : bounds[-1]], bounds - bounds[0])
            stops = np.cumsum(counts)
            full = folded(numbers, np.arange(max(0, len(numbers) - words + 1)), words)
            for stop, count in zip(stops.tolist(), counts.tolist(), strict=True):
                if count >= words:
                    found = np.sort(full[stop - count : stop - words + 1])
                    yield found[np.concatenate([[True], found[1:] != found[:-1]])]
                elif count:
                    yield folded(numbers, np.array([stop - count]), count)
                else:
                    yield empty
        low = high


def digest(shingles: np.ndarray, text: str, words: int) -> bytes:
    """128 bits that stand for a whole set: of its numbers, or of the words themselves if there is but one shingle."""
    if len(shingles) > 1:
        return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    lower = text.encode("utf-8", "surrogatepass").translate(LOWER.tobytes()).split()
    return hashlib.blake2b(b" ".join(lower[: max(words, 1)]), digest_size=16, person=b"one").digest()
