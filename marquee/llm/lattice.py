"""E8 lattice cells of random projections."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np

from marquee.llm.text import mix


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and move the worst coordinate if the sum is odd."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    r[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even-sum integer points and the same shifted by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) / 2 for v in product((1, -1), repeat=8) if np.prod(v) > 0]
    return np.array(out, np.float64)


@lru_cache(maxsize=64)
def projection(dim: int, table: int, width: int) -> np.ndarray:
    """``width`` random orthonormal directions (random ones if there are fewer dimensions)."""
    rng = np.random.default_rng((dim, table, 97))
    g = rng.normal(size=(dim, width))
    return np.linalg.qr(g)[0] if dim >= width else g / np.sqrt(dim)


def cells(unit: np.ndarray, table: int, blocks: int, scale: float, probes: int) -> np.ndarray:
    """(n, 1 + blocks * probes) cell codes: each row's own cell, then cells next to it.

    A cell is one lattice point per 8-dimensional block; a neighbouring cell differs in one
    block, by the short lattice vectors that lead nearest to the row.
    """
    x = unit @ projection(unit.shape[1], table, 8 * blocks) * (scale * np.sqrt(unit.shape[1] / 8))
    codes, near = [], []
    factors = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    for b in range(blocks):
        part = x[:, 8 * b:8 * b + 8]
        point = nearest_e8(part)
        gain = (part - point) @ neighbours().T
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        both = np.concatenate([point[:, None, :], point[:, None, :] + neighbours()[best]], axis=1)
        near.append(mix(((2 * both).astype(np.int64).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
                        + np.uint64(b * 1000 + table + 1)))
    own = sum(c[:, 0] for c in near)
    codes = [own] + [own - c[:, 0] + c[:, p] for c in near for p in range(1, probes + 1)]
    return mix(np.stack(codes, axis=1))
