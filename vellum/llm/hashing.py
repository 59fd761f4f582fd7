"""Word and window hashes over whole texts in numpy, and compact payloads of hashes for shuffles.

A word's hash is a polynomial over randomised bytes modulo 2**64, read off prefix sums, so a text costs
a few passes over its bytes and no loop over its words. Windows of words are hashed the same way over the
words' hashes. Texts are taken CHUNK bytes at a time, cut at white space, so memory doesn't follow a
text's length beyond a few numbers a word.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK + 1), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """Hashes of the words of UTF-8 text: maximal runs of bytes other than ASCII white space. lower: A-Z count as a-z."""
    return words_at(data, lower)[0]


def words_at(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the bytes where they start."""
    out, where, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # one word longer than a chunk: on to its end
                ends = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(c, end)) >= 0]
                cut = min(ends, default=n - 1)
            end = cut + 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        if lower:
            raw = _LOWER[raw]
        edge = np.flatnonzero(np.diff(_WHITE[raw].view(np.int8), prepend=1, append=1))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            power, inverse = _powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
            out.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
            where.append(starts + at)
        at = end
    return (np.concatenate(out), np.concatenate(where)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of `width` words; those that start less than width from the end are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((mix(words, 97 * salt) if salt else words) * power[: len(words)], out=total[1:])
    return mix((total[width:] - total[:n]) * inverse[:n], salt)


def pack(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences, one byte plane after the other; shuffles compress the high planes away."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def deal(parts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A stable order of rows by part, and each part's stretch in that order."""
    order = np.argsort(parts, kind="stable")
    own, first = np.unique(parts[order], return_index=True)
    ends = [*first[1:].tolist(), len(parts)]
    return order, [(int(p), slice(a, b)) for p, a, b in zip(own, first.tolist(), ends)]
