"""Affine frames: 4 x 4 matrices from translation, rotation, scaling and shear, and quaternions; small and on the driver."""

from __future__ import annotations

import numpy as np


def frame(translate=(0, 0, 0), rotate=(0, 0, 0), scale=(1, 1, 1), shear=(0, 0, 0)) -> np.ndarray:
    """Translation times rotations (radians about x, y, z) times scaling times shear."""
    t, s, h = np.eye(4), np.diag([*map(float, scale), 1.0]), np.eye(4)
    t[:3, 3] = translate
    h[0, 1], h[0, 2], h[1, 2] = shear
    m = t
    for ax, a in enumerate(rotate):
        r, (i, j) = np.eye(4), [(1, 2), (0, 2), (0, 1)][ax]
        r[i, i] = r[j, j] = np.cos(a)
        r[i, j], r[j, i] = np.sin(a), -np.sin(a)
        m = m @ r
    return m @ s @ h


def quaternion(m: np.ndarray) -> np.ndarray:
    """(x, y, z, w) of a rotation matrix, w not negative: the main eigenvector of its symmetric form."""
    r = np.asarray(m, float)[:3, :3]
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0], r[2, 1] - r[1, 2]],
        [0, r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1], r[0, 2] - r[2, 0]],
        [0, 0, r[2, 2] - r[0, 0] - r[1, 1], r[1, 0] - r[0, 1]],
        [0, 0, 0, r[0, 0] + r[1, 1] + r[2, 2]],
    ]) / 3
    q = np.linalg.eigh(np.triu(k) + np.triu(k, 1).T)[1][:, -1]
    return q if q[3] >= 0 else -q


def rotation(q) -> np.ndarray:
    x, y, z, w = np.asarray(q, float) / np.linalg.norm(q)
    m = np.eye(4)
    m[:3, :3] = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    return m
