"""Exact byte-pair encoding as a shortest walk over a double-array trie.

A sequence of tokens is the byte-pair encoding of its bytes exactly if every two
neighbours are the encoding of their own concatenation. So a prefix's encoding
is found from shorter prefixes' last tokens: token t may follow last[j] if the
two are such neighbours, and of all tokens that end at i exactly one may. This
is Viterbi's algorithm over the lattice of vocabulary matches, with that
condition in place of unigram scores; one pass, linear in the text's length.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

# Fixed value: the public pattern that splits text into segments before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a token's bytes in base64 and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The encoding by definition: the adjacent pair of the lowest rank merges first, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class DoubleArray:
    """A trie of byte strings in two integer arrays: from state s byte c leads to base[s] + c if check there is s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, tokens: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for token, rank in tokens.items():
            node = root
            for c in token:
                node = node.setdefault(c, {})
            node[-1] = rank
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        todo, free = [(root, 0)], 1
        while todo:
            node, s = todo.pop()
            value[s] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while free < size and check[free] != -1:
                free += 1
            at = max(free, codes[0] + 1)
            tries = 0
            while True:
                b = at - codes[0]
                while b + 257 > size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if check[at] == -1 and all(check[b + c] == -1 for c in codes):
                    break
                at += 1
                tries += 1
                if tries == 200 and len(codes) > 1:  # crowded; go on where the array is empty
                    at = max(at, self_end(check, at))
            base[s] = b
            for c in codes:
                check[b + c] = s
            todo.extend((node[c], b + c) for c in codes)
        return cls(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


def self_end(check: list[int], at: int) -> int:
    """The first state after at from which on 256 states are free, sought in steps of 256."""
    while at < len(check) and any(x != -1 for x in check[at : at + 256]):
        at += 256
    return at


@lru_cache(maxsize=4)
def double_array(path: str) -> DoubleArray:
    return DoubleArray.build(read_ranks(path))


class Encoder:
    """Counts or gives the tokens of single segments; made once in a worker. The arrays and ranks are the vocabulary's size, whatever the data's."""

    def __init__(self, ranks: dict[bytes, int], trie: DoubleArray, remember: int = 1_000_000) -> None:
        self.ranks, self.remember = ranks, remember
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.pairs: dict[int, bool] = {}
        self.counts: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        for t, r in ranks.items():
            try:
                self.whole[t.decode()] = r
            except UnicodeDecodeError:
                pass

    def neighbours(self, x: int, y: int) -> bool:
        """Whether x, y is the encoding of its own concatenation."""
        key = x << 32 | y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.remember:
                self.pairs.clear()
            a, b = self.bytes_of[x], self.bytes_of[y]
            known = self.pairs[key] = merged(a + b, self.ranks) == [a, b]
        return known

    def walk(self, piece: bytes) -> tuple[list[int], list[int]]:
        """last[i]: the last token of the encoding of piece[:i]; count[i]: how many tokens it has."""
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        base, check, value, neighbours = self.base, self.check, self.value, self.neighbours
        for j in range(n):
            before = last[j]
            if j and before < 0:
                raise ValueError("a byte of the text has no token")
            s = 0
            for i in range(j, n):
                t = base[s] + piece[i]
                if check[t] != s or (s == 0 and t == 0):
                    break
                s = t
                v = value[s]
                if v >= 0 and last[i + 1] < 0 and (not j or neighbours(before, v)):
                    last[i + 1], count[i + 1] = v, count[j] + 1
        return last, count

    def count(self, segment: str) -> int:
        n = self.counts.get(segment)
        if n is None:
            n = 1 if segment in self.whole else self.walk(segment.encode())[1][-1]
            if len(self.counts) >= self.remember:
                self.counts.clear()
            self.counts[segment] = n
        return n

    def encode(self, segment: str) -> list[int]:
        if (v := self.whole.get(segment)) is not None:
            return [v]
        piece = segment.encode()
        last, count = self.walk(piece)
        out, i = [0] * count[-1], len(piece)
        for k in range(len(out) - 1, -1, -1):
            out[k] = last[i]
            i -= len(self.bytes_of[last[i]])
        return out
