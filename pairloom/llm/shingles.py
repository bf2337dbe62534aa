"""64-bit hashes of words and word shingles for many texts at once.

Words are runs of ASCII letters, ASCII digits and characters beyond ASCII, of the lower-cased text. A text of fewer
words than a shingle has, but at least one, has one shingle of all its words.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
PRIME, STEP = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one behind the other, and where each text's begin."""
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(encoded) + b" ", np.uint8)
    word = IN_WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    sizes = end - begin
    ends_of_texts = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.searchsorted(begin, ends_of_texts)]).astype(np.int64)
    if not len(sizes):
        return np.empty(0, np.uint64), offsets
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        each = (raw[word].astype(np.uint64) + np.uint64(1)) * powers(PRIME, int(sizes.max()))[place]
        return mix(np.add.reduceat(each, first) + sizes.astype(np.uint64) * STEP), offsets


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in their order, and where each text's begin."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    # a short text's one shingle adds its words only; others add `size` of them from each place on
    place = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], counts) + np.repeat(at[:-1], counts)
    width = np.repeat(np.minimum(n, size), counts)
    total = np.zeros(len(place), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        for k, p in enumerate(powers(STEP, size)):
            total += np.where(k < width, padded[place + k] * p, np.uint64(0))
    return mix(total), offsets
