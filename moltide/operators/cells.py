"""Periodic cells of any shape, for NumPy inside tasks; the expressions of ``geometry`` cover cells with right angles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Cell:
    """Three cell vectors (rows) and the distance from which on a combination counts as cut apart; by default half the shortest vector."""

    vectors: tuple[tuple[float, float, float], ...]
    cutoff: float | None = None

    def __post_init__(self):
        v = np.asarray(self.vectors, float)
        if v.shape != (3, 3) or abs(np.linalg.det(v)) < 1e-12:
            raise ValueError("a cell has three independent vectors")

    @property
    def limit(self) -> float:
        return float(np.linalg.norm(self.vectors, axis=1).min()) / 2.0 if self.cutoff is None else self.cutoff

    @property
    def volume(self) -> float:
        return abs(float(np.linalg.det(np.asarray(self.vectors, float))))

    def shortest(self, d: np.ndarray) -> np.ndarray:
        """Shortest images of differences (..., 3): rounded in cell coordinates, then against the 26 images around, which covers skewed cells."""
        v = np.asarray(self.vectors, float)
        d = d - np.rint(d @ np.linalg.inv(v)) @ v
        if np.count_nonzero(v - np.diag(np.diag(v))) == 0:
            return d
        best, size = d, (d * d).sum(-1)
        for shift in np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij"), -1).reshape(-1, 3):
            other = d + shift @ v
            length = (other * other).sum(-1)
            near = length < size - 1e-12
            best, size = np.where(near[..., None], other, best), np.where(near, length, size)
        return best

    def unwrapped(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, atoms, 3) -> coordinates relative to the first atom as shortest images, and whether all atoms are nearer to each other than the limit."""
        d = self.shortest(r - r[:, :1])
        whole = np.ones(len(d), bool)
        for i in range(d.shape[1] - 1):
            gap = d[:, i + 1 :] - d[:, i : i + 1]
            whole &= ((gap * gap).sum(2) < self.limit**2).all(1)
        return d, whole
