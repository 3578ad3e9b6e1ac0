"""Pixel metrics of tiles as Arrow functions over flat ``array<int>`` grey or RGB pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TISSUE_BELOW = 240
NAMES = ["tissue", "mean", "std", "edge", "entropy", "dark", "saturation"]
METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])
BOXES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h", "area")]))


def box_mean(image: np.ndarray) -> np.ndarray:
    """Mean over 3 by 3 pixels, borders repeated."""
    p = np.pad(image.astype(float), 1, mode="edge")
    h, w = image.shape
    return sum(p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)) / 9


def entropy(values: np.ndarray, bins: int = 256) -> float:
    n = np.bincount(np.clip(values.ravel().astype(np.int64) * bins // 256, 0, bins - 1), minlength=bins)
    p = n[n > 0] / max(1, n.sum())
    return float(-(p * np.log2(p)).sum())


def edge_strength(grey: np.ndarray) -> float:
    """Mean absolute gradient along both axes."""
    g = grey.astype(float)
    parts = [np.abs(np.diff(g, axis=a)) for a in (0, 1) if g.shape[a] > 1]
    return float(np.mean([p.mean() for p in parts])) if parts else 0.0


def metrics(rgb: np.ndarray) -> dict[str, float]:
    grey = rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114
    top, low = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    return {
        "tissue": float((grey < TISSUE_BELOW).mean()),
        "mean": float(grey.mean()),
        "std": float(grey.std()),
        "edge": edge_strength(grey),
        "entropy": entropy(grey),
        "dark": float((grey < 100).mean()),
        "saturation": float(np.where(top > 0, (top - low) / np.maximum(top, 1), 0).mean()),
    }


@F.pandas_udf(METRICS)
def tile_metrics(pixels: pd.Series, side: pd.Series) -> pd.DataFrame:
    """Metrics of square RGB tiles given as flat pixels, row by row."""
    return pd.DataFrame([metrics(np.asarray(p, np.int64).reshape(s, s, 3)) for p, s in zip(pixels, side)], columns=NAMES)


def labelled(mask: np.ndarray) -> np.ndarray:
    """A number over 0 for each 4-connected part of a mask (the place of its last pixel), 0 elsewhere.

    Every pixel points at the largest number around it, and pointers are followed to their end, so rounds grow with the logarithm of a part's extent.
    """
    h, w = mask.shape
    point = np.where(mask, np.arange(1, mask.size + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(point, 1)
        most = np.max([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]], axis=0) * mask
        # what a pixel's own mark learns, all pixels of that mark learn
        learnt = np.zeros(mask.size + 1, np.int64)
        np.maximum.at(learnt, point.ravel(), most.ravel())
        new = learnt[point] * mask
        while (learnt[new] > new).any():
            new = learnt[new] * mask
        if (new == point).all():
            return point
        point = new


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of the 4-connected parts of a mask, largest first."""
    label = labelled(mask)
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        out.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, len(xs)))
    return sorted(out, key=lambda b: (-b[4], b[1], b[0]))


@F.pandas_udf(BOXES)
def mask_boxes(mask: pd.Series, width: pd.Series, least: pd.Series) -> pd.Series:
    """Boxes of the connected parts of flat boolean masks with an area of at least ``least``."""
    keys = ("x", "y", "w", "h", "area")
    return pd.Series([[dict(zip(keys, b)) for b in components(np.asarray(m, bool).reshape(-1, w)) if b[4] >= a] for m, w, a in zip(mask, width, least)])
