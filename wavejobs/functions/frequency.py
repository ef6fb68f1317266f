"""Frequency and direction grids; all are shared by a whole dataset and small."""

from __future__ import annotations

import numpy as np


def model_frequency(n: int = 30, first: float = 0.03453, ratio: float = 1.1) -> np.ndarray:
    return first * ratio ** np.arange(n)


def model_direction_degrees(n: int = 24) -> np.ndarray:
    return (np.arange(n) + 0.5) * 360.0 / n


def edges_from_centres(centres, *, logarithmic: bool = False, ratio: float = 1.1) -> np.ndarray:
    """Bin edges half-way between centres, or their geometric means for a logarithmic grid."""
    c = np.asarray(centres, np.float64)
    if c.ndim != 1 or len(c) < 2:
        raise ValueError("a one-dimensional grid of at least two centres is needed")
    if logarithmic:
        inner, first, last = np.sqrt(c[:-1] * c[1:]), c[0] / ratio**0.5, c[-1] * ratio**0.5
    else:
        inner = (c[:-1] + c[1:]) / 2
        first, last = c[0] - (inner[0] - c[0]), c[-1] + (c[-1] - inner[-1])
    return np.concatenate([[first], inner, [last]])


def model_edges() -> np.ndarray:
    return edges_from_centres(model_frequency(), logarithmic=True)


def widths(centres, *, logarithmic: bool = True) -> np.ndarray:
    return np.diff(edges_from_centres(centres, logarithmic=logarithmic))


def rebin_weights(source, target_edges) -> list[list[tuple[int, float]]]:
    """For each target bin the source indices with their centre in it, and width over bin width."""
    f, e = np.asarray(source, np.float64), np.asarray(target_edges, np.float64)
    w = np.diff(edges_from_centres(f))
    return [[(int(i), float(w[i] / (b - a))) for i in np.flatnonzero((f >= a) & (f < b))] for a, b in zip(e[:-1], e[1:])]
