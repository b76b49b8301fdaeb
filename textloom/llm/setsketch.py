"""SetSketch (Ertl, 2021): registers of exponentially spaced, truncated minima.

Register i of a set is clip(floor(1 - log_b(x_i)), 0, q + 1), where x_i is the least
of the elements' exponential hash values with rate a. Registers of a union are
the larger of both sets' registers, so sketches merge; the smaller b, the more
two sets' equal registers follow their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from textloom.llm.words import mix

B, A, Q = 1.001, 20.0, (1 << 16) - 2


def coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, m + 1, dtype=np.uint64)
    return mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(i + np.uint64(0x632BE59BD9B4E019))


def registers(hashes: np.ndarray, m: int, factors: tuple[np.ndarray, np.ndarray] | None = None, block: int = 512) -> np.ndarray:
    """m 16-bit registers of a set of mixed 64-bit hashes; all zero for an empty set."""
    f, g = factors or coefficients(m)
    if not len(hashes):
        return np.zeros(m, np.uint16)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), block):
        np.minimum(least, (np.multiply.outer(hashes[lo : lo + block], f) + g).min(axis=0), out=least)
    u = np.clip((least.astype(np.float64) + 0.5) * 2.0**-64, 2.0**-65, 1 - 2.0**-53)
    x = -np.log1p(-u) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def jaccard(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, grid: int = 400) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sets of n1 and n2 elements, of whose registers so many are more, less and equal in the first."""
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = top * np.linspace(0, 1, grid)[None, :]
    p = lambda x: -np.log1p(-x * (B - 1) / B) / np.log(B)
    up, down = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, q: np.where(k[:, None] > 0, k[:, None] * np.log(np.maximum(q, 0)), 0.0)
        like = part(more, up) + part(less, down) + part(equal, 1 - up - down)
    return np.take_along_axis(j, np.nanargmax(like, axis=1)[:, None], axis=1)[:, 0]
