"""Positions on Hilbert curves of vectors' projections, many vectors at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def curve_position(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each cell on the curve through the grid of 2 ** bits cells a side; dims * bits must stay under 64.

    From the coarsest level down, each level's reflections and exchanges of axes are undone; the bits of the axes, read
    level by level and turned from Gray code, are the position.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            upper = (x[i] >> level & 1).astype(bool)
            change = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, change)
            x[i] ^= change
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    position = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            position = position << 1 | (x[i] >> level & 1)
    return position


@dataclass
class Curves:
    """Several orderings: each has directions to project on, the quantiles of the projections, and a shift of its own."""

    directions: np.ndarray  # orderings x vector x dims
    quantiles: np.ndarray  # orderings x dims x steps
    shifts: np.ndarray  # orderings x dims
    bits: int

    #: A shift is at most this part of the grid's side.
    MOST_SHIFT = 0.3

    @classmethod
    def fit(cls, sample: np.ndarray, orderings: int, dims: int, bits: int, seed: int = 42, steps: int = 257) -> Curves:
        """Random directions, longer along axes of much variance, made orthonormal; quantiles of the sample along them."""
        rng = np.random.default_rng(seed)
        variance, axes = np.linalg.eigh(np.atleast_2d(np.cov(sample, rowvar=False)) if len(sample) > 1 else np.eye(sample.shape[1]))
        spread = axes * np.sqrt(np.maximum(variance, 1e-12 * max(variance.max(), 1e-300)))
        dims = min(dims, sample.shape[1])
        directions = np.stack([np.linalg.qr(spread @ rng.normal(size=(len(axes), dims)))[0] for _ in range(orderings)])
        quantiles = np.quantile(np.einsum("nv,ovd->ond", sample, directions), np.linspace(0, 1, steps), axis=1).transpose(1, 2, 0)
        return cls(directions, quantiles, rng.uniform(0, cls.MOST_SHIFT, (orderings, dims)), bits)

    def __len__(self) -> int:
        return len(self.directions)

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        """Where the vectors lie on the curve of one ordering."""
        at, steps = vectors @ self.directions[ordering], self.quantiles.shape[2]
        side = 1 << self.bits
        cells = np.empty(at.shape, np.int64)
        for d in range(at.shape[1]):
            share = np.interp(at[:, d], self.quantiles[ordering, d], np.linspace(0, 1, steps))
            cells[:, d] = np.minimum((share + self.shifts[ordering, d]) / (1 + self.MOST_SHIFT) * side, side - 1)
        return curve_position(cells, self.bits)
