"""Vectorised word hashing of UTF-8 texts: one pass of numpy over the bytes of many texts.

A word's hash is a polynomial of its bytes modulo 2**64 with a final mix, so equal words get equal hashes everywhere. Different words
differ but for chance (2**-64), unless someone builds words of equal hashes on purpose.
"""

from __future__ import annotations

import numpy as np

from .common import ship_by_value

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes worked on at a time; bounds the memory at about 60 times this.
CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: What a byte counts for in a hash: any fixed odd numbers.
BYTE_VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lower_bytes(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """ASCII capitals become small; with ``latin`` those of U+00C0 to U+00DE too."""
    out = LOWER[data]
    if latin and len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[after]
        after = after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        out[after] += 0x20
    return out


def _chunk(data: np.ndarray, word: np.ndarray, first: np.ndarray, prefix: int) -> tuple[np.ndarray, ...]:
    """Starts, ends, hashes and hashes of the beginnings of the words of one chunk; ``first`` marks bytes at which a text starts."""
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return starts, starts, none, none
    ends_at = word.copy()
    ends_at[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(ends_at) + 1
    lengths = ends - starts
    inside = np.flatnonzero(word)
    places = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = BYTE_VALUE[data[inside]] * _powers(int(lengths.max()))[places]
    hashes = mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    if not prefix:
        return starts, ends, hashes, hashes
    # A letter of several bytes stays whole.
    letters = np.cumsum((data[inside] & 0xC0) != 0x80)
    within = letters - np.repeat(letters[np.cumsum(lengths) - lengths], lengths) < prefix
    short = np.add.reduceat(within.astype(np.int64), np.cumsum(lengths) - lengths)
    return starts, ends, hashes, mix(np.add.reduceat(terms[within], np.cumsum(short) - short) + short.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, latin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts ``data[offsets[i]:offsets[i + 1]]``, small letters: ``(starts, ends, hashes, bounds)``.

    Word ``j`` is one of text ``i`` if ``bounds[i] <= j < bounds[i + 1]``. Words are runs of bytes in ``is_word``.
    """
    starts, ends, hashes, _, bounds = words_and_beginnings(data, offsets, is_word, 0, latin)
    return starts, ends, hashes, bounds


def words_and_beginnings(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, prefix: int, latin: bool = False) -> tuple[np.ndarray, ...]:
    """As ``words``, with the hashes of the words' first ``prefix`` letters before the bounds."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n:  # a word stays whole
            gap = np.flatnonzero(~is_word[data[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + CHUNK)
        piece = data[at:end]
        first = np.zeros(len(piece), bool)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)]
        first[inner - at] = True
        s, e, h, p = _chunk(lower_bytes(piece, latin), is_word[piece], first, prefix)
        parts.append((s + at, e + at, h, p))
        at = end
    if parts:
        starts, ends, hashes, beginnings = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts = ends = np.zeros(0, np.int64)
        hashes = beginnings = np.zeros(0, np.uint64)
    return starts, ends, hashes, beginnings, np.searchsorted(starts, offsets)


ship_by_value(__name__)
