"""CRC-32 of all word n-grams of a text in numpy, without a loop over its words.

The register after a message is linear in the register before it and in the message: a gram's checksum is the checksum of
the gram that is one word shorter, advanced by the next word's length in zero bytes, combined with that word's own register. So each
word's bytes are read once, and each gram costs four table look-ups.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Lengths up to which advancing has a table of its own.
SHORT = 64
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _byte_table()


def _look(tables: np.ndarray, base, c: np.ndarray) -> np.ndarray:
    """tables: 4 x 256 entries from each base on, one table for each byte of c."""
    out = tables[base + (c & 255)]
    for j in (1, 2, 3):
        out ^= tables[base + (256 * j) + ((c >> np.uint32(8 * j)) & 255)]
    return out


def _zero_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that advance a register by 0 to SHORT zero bytes, and by each power of two."""
    same = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    each = [same]
    for _ in range(SHORT):
        c = each[-1]
        each.append(_TABLE[c & 255] ^ (c >> 8))
    powers = [each[1]]
    for _ in range(39):
        powers.append(_look(powers[-1], 0, powers[-1]))
    return np.concatenate(each), powers


_ZERO, _POWERS = _zero_tables()


def advance(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers c after `by` zero bytes each."""
    out = _look(_ZERO, np.minimum(by, SHORT) * 1024, c)
    far = np.flatnonzero(by > SHORT)
    if len(far):
        x, k = c[far], by[far]
        for j in range(int(k.max()).bit_length()):
            x = np.where((k >> j) & 1, _look(_POWERS[j], 0, x), x)
        out[far] = x
    return out


def registers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The register that each stretch of data leaves if it was 0 before."""
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= SHORT)
    order = short[np.argsort(lengths[short].astype(np.uint8), kind="stable")[::-1]]
    own, at = lengths[order], starts[order]
    c = np.zeros(len(order), np.uint32)
    for j in range(int(own[0]) if len(own) else 0):
        m = int(np.searchsorted(-own, -j))  # those longer than j
        c[:m] = _TABLE[(c[:m] ^ data[at[:m] + j]) & 255] ^ (c[:m] >> 8)
    out[order] = c
    for i in np.flatnonzero(lengths > SHORT):
        a, n = int(starts[i]), lengths[i : i + 1]
        out[i] = np.uint32(zlib.crc32(data[a : a + int(n[0])])) ^ _ONES ^ advance(np.array([_ONES]), n)[0]
    return out


def gram_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size from 1 to `most`: (first word's index, CRC-32) of all runs of so many words of one group, joined by one space."""
    lengths = ends - starts
    own = registers(data, starts, lengths)
    state = advance(np.full(len(own), _ONES), lengths) ^ own
    first, out = np.arange(len(own)), [(np.arange(len(own)), state ^ _ONES)]
    spaced = advance(np.full(len(own), _TABLE[0x20]), lengths) ^ own  # of a space and the word
    for size in range(2, most + 1):
        last = first + size - 1
        fits = np.flatnonzero(last < len(own))
        fits = fits[group[last[fits]] == group[first[fits]]]
        first, last = first[fits], last[fits]
        state = advance(state[fits], lengths[last] + 1) ^ spaced[last]
        out.append((first, state ^ _ONES))
    return out
