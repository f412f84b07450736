"""Whole-batch text kernels: word spans and 64-bit hashes of an Arrow string column, without a Python loop per word.

Texts are cut into slices of about SLICE_BYTES (a longer text is a slice of its own), so memory follows the longest
text, not the batch. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD1342543DE82EF95)
_C = np.uint64(0xA0761D6478BD642F)


def give_back() -> None:
    """Returns memory that is no longer used to the system: Python workers live on after a task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def byte_table(chars: set[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Words are runs of anything but the six ASCII blanks.
BLANK_WORDS = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words are runs of ASCII letters, digits and all that is not ASCII.
PLAIN_WORDS = byte_table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)
_BYTES_LOWER = _BYTES[_LOWER]

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.empty(size, dtype=np.uint64)
        known[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, size - done)
            known[done : done + more] = known[:more] * step
            done += more
        if size <= 4 * SLICE_BYTES:
            _powers[name] = known
    return known[:n]


class Words:
    """Words of a slice of texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = table[data]
        n = len(data)
        before = np.empty(n, dtype=bool)
        before[1:] = inside[:-1]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        after[:-1] = inside[1:]
        after[offsets[1:][filled] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, offsets)  # text d has the words of[d]:of[d + 1]
        power = _power(int(_R), n + 1, "r")
        back = _power(_inverse(int(_R)), n + 1, "i")
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTES_LOWER if lower else _BYTES)[data] * power[:n], out=sums[1:])
        hashes = (sums[self.ends] - sums[self.starts]) * back[self.starts]
        self.hashes = mix64(hashes ^ ((self.ends - self.starts).astype(np.uint64) * _MUL))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each word on, and whether all n are of one text."""
        h, size = self.hashes, len(self.hashes)
        out = gram_hashes(h, n)
        last = np.repeat(self.of[1:], self.counts)
        ok = np.arange(size) + n <= last
        return out, ok


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i + n] at each i (rubbish where fewer follow), by doubling."""
    size = len(h)

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        y = np.zeros(size, dtype=np.uint64)
        if k < size:
            y[: size - k] = x[k:]
        return y

    total, done, block, width, left = None, 0, h, 1, n
    while left:
        if left & 1:
            if total is None:
                total, done = block, width
            else:
                total = total * np.uint64(pow(int(_C), width, 1 << 64)) + shifted(block, done)
                done += width
        left >>= 1
        if left:
            block = block * np.uint64(pow(int(_C), width, 1 << 64)) + shifted(block, width)
            width *= 2
    return mix64(total + np.uint64(n * int(_MUL) % (1 << 64)))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence; equals gram_hashes(h, len(h))[0]."""
    return gram_hashes(h, len(h))[0]


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of consecutive texts of about SLICE_BYTES together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_slices(texts: pa.Array, table: np.ndarray = BLANK_WORDS, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for at, end, data, offsets in slices(texts):
        yield at, end, Words(data, offsets, table, lower)
