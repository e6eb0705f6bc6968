"""Morphs over arrays, to hold the column forms against."""

import numpy as np

from loomwork.functions.kernels import sample_at, saturated
from loomwork.operators.morphs import triangles


def warp(image: np.ndarray, source: np.ndarray, target: np.ndarray, mesh: list[tuple[int, int, int]]) -> np.ndarray:
    """The image with each triangle of source points mapped to its target; degenerate ones are skipped."""
    h, w = image.shape[:2]
    out = np.zeros(image.shape, dtype=float)
    for t in mesh:
        a, b = source[list(t)].astype(float), target[list(t)].astype(float)
        square = np.column_stack([b, np.ones(3)])
        if abs(np.linalg.det(square)) < 1e-6:
            continue
        x0, y0 = np.maximum(np.floor(b.min(axis=0)).astype(int), 0)
        x1, y1 = np.minimum(np.ceil(b.max(axis=0)).astype(int), (w - 1, h - 1))
        y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        shares = np.stack([x, y, np.ones_like(x)], axis=-1) @ np.linalg.inv(square)
        inside = (shares >= -1e-9).all(axis=-1)
        at = shares[inside] @ a
        out[y[inside], x[inside]] = sample_at(image, at[:, 0], at[:, 1])[:, :] if image.ndim == 3 else sample_at(image, at[:, 0], at[:, 1])
    return out


def blend(image_a: np.ndarray, image_b: np.ndarray, points_a: np.ndarray, points_b: np.ndarray, alpha: float) -> np.ndarray:
    """Both images warped to the points between theirs and mixed: alpha is the share of b."""
    if image_a.shape != image_b.shape:
        raise ValueError("images must have the same shape")
    h, w = image_a.shape[:2]
    xs, ys = ((0, (w - 1) / 2, w - 1), (0, (h - 1) / 2, h - 1))
    border = np.array([(x, y) for y in ys for x in xs if (x, y) != (xs[1], ys[1])], dtype=float)
    a, b = np.vstack([points_a, border]), np.vstack([points_b, border])
    middle = (1 - alpha) * a + alpha * b
    mesh = triangles(middle)
    return saturated((1 - alpha) * warp(image_a, a, middle, mesh) + alpha * warp(image_b, b, middle, mesh))
