"""Words of many texts and their 64-bit hashes, by numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but white space; and letters, digits and every byte beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes], word_bytes: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """The hash of each word (A-Z lower-cased), in order; where each text's words begin (one more
    entry than texts); then for each length in stems the hashes of the words' first bytes."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = word_bytes[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends alternate; the last byte is a space
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, *(np.zeros(0, np.uint64) for _ in stems)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        terms = _BYTE[data[inside]] * powers[place]
        h = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
        return h, bounds, *(mix(np.add.reduceat(np.where(place < k, terms, 0), first) ^ np.uint64(k)) for k in stems)


def word_starts(texts: list[bytes], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of word_hashes begin and end in the texts, joined by one byte each."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(word_bytes[data], prepend=False))
    return edge[::2], edge[1::2]


def chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or one longer text."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
