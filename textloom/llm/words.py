"""Words, word triples and their hashes, for batches in Python workers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np

# Fixed value: a word is a maximal run of letters and digits; "_" is neither.
WORD = re.compile(r"[^\W_]+")
_CHUNK = 1 << 16  # characters whose words are hashed together, so that arrays stay in the cache


def lowered(title: str | None, text: str | None) -> str:
    """title, one space and text, lower-cased; null counts as empty."""
    return f"{title or ''} {text or ''}".lower()


def words_of(title: str | None, text: str | None) -> list[str]:
    """The words of title, one space and text, lower-cased; null counts as empty."""
    return WORD.findall(lowered(title, text))


def pack(title: str | None, text: str | None) -> bytes:
    """title, one space and text, deflated for the way to where pairs are verified."""
    return zlib.compress(f"{title or ''} {text or ''}".encode("utf-8", "surrogatepass"))


def unpacked(body: bytes) -> str:
    """What was packed, lower-cased."""
    return zlib.decompress(body).decode("utf-8", "surrogatepass").lower()


def packed_words(body: bytes) -> list[str]:
    return WORD.findall(unpacked(body))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words; then the memory starts anew."""

    def __init__(self, most: int = 500_000) -> None:
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n].copy()
    for i in range(1, k):
        h = mix(h) + ids[i : n + i]
    return mix(h)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is part of words, and a number that stands for it."""
    inside = np.zeros(0x110000, bool)
    for m in WORD.finditer(np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
        inside[m.start() : m.end()] = True
    return inside, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _places(n: int) -> np.ndarray:
    """An odd factor for each of the first n places of a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _hashed_chunk(bodies: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    inside, numbers = _characters()
    codes = np.frombuffer(" ".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(inside[codes])
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    starts = np.flatnonzero(first)
    sizes = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    factors = _places(max(64, 1 << int(sizes.max(initial=1)).bit_length()))
    words = np.add.reduceat(numbers[codes[at]] * factors[place], starts) if len(at) else np.empty(0, np.uint64)
    runs = shingle_hashes(words, k)
    bounds = np.searchsorted(at[starts], np.cumsum([0, *(len(b) + 1 for b in bodies)])).tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield words[a:b], runs[a : max(a, b - k + 1)]


def hashed(bodies: Iterable[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each lower-cased text, the 64-bit hashes of its words and of all runs of k of them, in order.

    A word's hash is the sum over its characters of the character's number times
    the place's factor, so that arrays of all characters take the place of a loop
    over words. These are other hashes than WordHashes has.
    """
    chunk, size = [], 0
    for body in bodies:
        chunk.append(body)
        size += len(body)
        if size >= _CHUNK:
            yield from _hashed_chunk(chunk, k)
            chunk, size = [], 0
    if chunk:
        yield from _hashed_chunk(chunk, k)


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct numbers of a sorted array."""
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return h[first]


def triples(words: list[str]) -> set[tuple[str, str, str]]:
    return set(zip(words, words[1:], words[2:]))
