"""E8 lattice hashing: nearest lattice points and their neighbours."""

from __future__ import annotations

import itertools

import numpy as np

from chronoweave.llm.hashing import constants, mix


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (whole coordinates with an even sum)."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        rows = np.arange(len(odd))
        near[odd, worst] += np.where(gap[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead from a cell to the cells that touch it."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


class LatticeHash:
    """Keys of the cells of unit vectors in several tables.

    A table projects a vector with random matrices to ``blocks`` times 8 numbers
    and decodes each eight to its nearest E8 point; the points together are the
    cell. Besides its own cell a vector is filed under ``probes`` cells that touch
    it, in order of the distance to their points.
    """

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.proj = rng.standard_normal((tables, blocks, dim, 8)) * scale
        self.move = rng.random((tables, blocks, 8))
        self.steps, self.probes = minimal_vectors(), probes
        self.names = constants(8 * blocks, seed)
        self.table = constants(tables, seed + 1)

    def name(self, points: list[np.ndarray], table: int) -> np.ndarray:
        whole = np.concatenate([np.rint(2 * p) for p in points], axis=-1).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return mix((mix(whole + self.names) * self.names).sum(axis=-1, dtype=np.uint64) + self.table[table]).view(np.int64)

    def keys(self, units: np.ndarray) -> np.ndarray:
        """Row per vector: 1 + probes keys of each table."""
        out = []
        rows = np.arange(len(units))
        for t, (mats, moves) in enumerate(zip(self.proj, self.move)):
            placed = [units @ m + v for m, v in zip(mats, moves)]
            home = [nearest_e8(p) for p in placed]
            out.append(self.name(home, t))
            # moving from the home point by a step s changes the squared distance by |s|^2 - 2 s.(x - home)
            worse = np.concatenate([2 - 2 * (p - h) @ self.steps.T for p, h in zip(placed, home)], axis=1)
            best = np.argpartition(worse, self.probes, axis=1)[:, : self.probes] if self.probes else np.empty((len(units), 0), int)
            for k in range(self.probes):
                block, step = np.divmod(best[:, k], len(self.steps))
                near = [h + np.where((block == b)[:, None], self.steps[step], 0) for b, h in enumerate(home)]
                out.append(self.name(near, t))
        return np.stack(out, axis=1) if len(rows) else np.empty((0, len(out)), np.int64)
