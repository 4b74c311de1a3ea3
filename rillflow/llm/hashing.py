"""64-bit hashes of words and word windows over whole Arrow columns, with numpy.

A column of texts is one byte buffer.  Word borders come from a table of the
separators.  A word is hashed by chaining splitmix64 over its 8-byte pieces, so
up to 8 bytes without a collision; beyond ``LONG`` bytes by BLAKE2b.  A window
is folded from halves, each pair of halves mixed.  No step is linear, so no
pattern of bytes or words collides for every seed.  Hashes only find
candidates: what rests on equality compares words, or ``digest``s of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: The separators of words: space and the control characters tab to carriage return.
SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8)
U = np.uint64
#: Words of more bytes are hashed one by one.
LONG = 64
#: The lowest 0 to 8 bytes of a little-endian 64-bit integer.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n 64-bit values that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins and the last ends.  Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def spans(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Rows i to j whose bytes together are ``most`` at the most, or one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def digest(data: bytes) -> bytes:
    """128 bits of BLAKE2b: no two inputs with one digest are known or can be made."""
    return blake2b(data, digest_size=16).digest()


class Words:
    """Hashes of words.  With ``lower``, A to Z count as a to z.  Equal words have equal hashes for equal seeds."""

    def __init__(self, seed: int, lower: bool):
        self.seed = stream(seed, 1)[0]
        self.lower = np.arange(256, dtype=np.uint8) if lower else None
        if lower:
            self.lower[65:91] += 32
        self.gap = np.zeros(256, dtype=bool)
        self.gap[SPACES] = True

    def folded(self, data: np.ndarray) -> np.ndarray:
        """The bytes as they count."""
        return data if self.lower is None else self.lower[data]

    def borders(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word starts and ends, and how many words stand before each text.  offsets begin at 0."""
        word = ~self.gap[data]
        before, after = np.empty_like(word), np.empty_like(word)
        if len(word):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = offsets[(offsets > 0) & (offsets < len(word))]
            before[inner] = False
            after[inner - 1] = False
        starts = np.flatnonzero(word & ~before)
        return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if not len(size):
            return np.zeros(0, dtype=np.uint64)
        bytes_ = np.zeros(len(data) + 8, dtype=np.uint8)
        bytes_[: len(data)] = self.folded(data)
        at = np.ndarray((len(data) + 1,), "<u8", bytes_.data, 0, (1,))  # the 8 bytes from each place on
        out = mix((at[starts] & LOW[np.minimum(size, 8)]) ^ self.seed)
        rest = np.flatnonzero((size > 8) & (size <= LONG))
        k = 8
        while len(rest):
            n = size[rest] - k
            out[rest] = mix(out[rest] + (at[starts[rest] + k] & LOW[np.minimum(n, 8)]) * U(0x9E3779B97F4A7C15))
            k += 8
            rest = rest[n > 8]
        salt = self.seed.tobytes()
        for w in np.flatnonzero(size > LONG):
            out[w] = int.from_bytes(blake2b(bytes_[starts[w] : ends[w]].tobytes(), digest_size=8, key=salt).digest(), "little")
        return mix(out + size.astype(np.uint64))


def _joined(left: np.ndarray, right: np.ndarray, factor: np.uint64) -> np.ndarray:
    out = left * factor
    out ^= out >> U(29)
    out += right
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(32)
    return out


def windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words; window i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = stream(seed, 64) | U(1)
    part, wide, out, have, level = words, 1, None, 0, 0
    while True:  # binary digits of size: part holds windows of 1, 2, 4, ... words
        if size & wide:
            out = part if out is None else _joined(out[: len(words) - have - wide + 1], part[have:], factors[2 * level])
            have += wide
        if have == size:
            return mix(out + U(size))
        part, wide, level = _joined(part[: len(part) - wide], part[wide:], factors[2 * level + 1]), 2 * wide, level + 1


def within(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of the windows over all texts lie in one text; first: words before each text."""
    n = max(0, total - size + 1)
    inside = np.ones(n + 1, dtype=np.int8)
    for k in range(1, size):  # the last size - 1 starts of each text
        at = first[1:] - k
        at = at[(at >= first[:-1]) & (at < n)]
        inside[at] = 0
    return inside[:n].astype(bool)
