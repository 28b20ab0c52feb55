"""Numeric kernels on images and features, and the plug-in interface for models.

Kernels that need a model or an image library are not part of the engine: they
register under a name and run inside ``apply_model``, loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from figmill.operators.consensus import agreeing

_LOADERS: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def register_model(name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """Make a model known: ``load()`` runs once per worker and returns a function of a batch."""
    _LOADERS[name] = load


def apply_model(rows: DataFrame, name: str, schema: str, load: Callable | None = None) -> DataFrame:
    """Rows through a model a batch at a time; a model that gives fewer rows drops the failed ones."""
    load = load or _LOADERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            out = model(pdf)
            if len(out):
                yield out.reset_index(drop=True)

    return rows.mapInPandas(run, schema)


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest pixel."""
    y = np.minimum((np.arange(h) + 0.5) * image.shape[0] / h, image.shape[0] - 1).astype(int)
    x = np.minimum((np.arange(w) + 0.5) * image.shape[1] / w, image.shape[1] - 1).astype(int)
    return image[y[:, None], x[None, :]]


def letterbox(image: np.ndarray, h: int, w: int, fill: int = 114) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Image fitted into h x w and padded evenly; the gain and the padding (x, y)."""
    gain = min(h / image.shape[0], w / image.shape[1])
    nh, nw = round(image.shape[0] * gain), round(image.shape[1] * gain)
    out = np.full((h, w, *image.shape[2:]), fill, image.dtype)
    dy, dx = (h - nh) / 2, (w - nw) / 2
    top, left = round(dy - 0.1), round(dx - 0.1)
    out[top:top + nh, left:left + nw] = resize(image, nh, nw)
    return out, gain, (dx, dy)


def to_tensor(image: np.ndarray) -> np.ndarray:
    """One image, channels first and reversed, in 0..1."""
    return np.ascontiguousarray(image[..., ::-1].transpose(2, 0, 1)[None]).astype(np.float32) / 255


def standardise(image: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    return ((image.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def equalise(image: np.ndarray) -> np.ndarray:
    """Histogram equalisation of an 8-bit grey image."""
    n = np.bincount(image.ravel(), minlength=256)
    first = np.flatnonzero(n)[0]
    rest = image.size - n[first]
    if rest == 0:
        return image.copy()
    table = np.round((np.cumsum(n) - n[first]) * 255 / rest).clip(0, 255).astype(np.uint8)
    return table[image]


def enlarge_factor(h: int, w: int, least: int = 300) -> int:
    """Doublings until both sides reach a size."""
    k = 1
    while min(h, w) * k < least:
        k *= 2
    return k


def root_features(d: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    return np.sqrt(d / (np.abs(d).sum(axis=1, keepdims=True) + eps))


def chain_matches(a: np.ndarray, b: np.ndarray, share: float = 0.5, ratio: float = 0.75, same: bool = False) -> np.ndarray:
    """Pairs (i, j) of features by a chain of distance ratios, then one to one by the smaller distance.

    For each feature of a the nearest of b are taken while each distance is below
    ``ratio`` times the next; ``same`` leaves out a feature's match with itself.
    """
    if not len(a) or not len(b):
        return np.empty((0, 2), int)
    dist = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
    if same:
        np.fill_diagonal(dist, np.inf)
    k = min(dist.shape[1], max(2, round(len(b) * share)))
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    found = []
    for i, near in enumerate(order):
        d = dist[i, near]
        for n in range(len(near) - 1):
            if not np.isfinite(d[n + 1]) or not d[n] < ratio * d[n + 1]:
                break
            found.append((d[n], i, int(near[n])))
    used_a, used_b, out = set(), set(), []
    for _, i, j in sorted(found):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.append((i, j))
    return np.array(sorted(out), int).reshape(-1, 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def half(pts):
        out = []
        for q in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def hull_mask(points: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels inside or on the hull of the points; empty for fewer than three corners."""
    c = hull(points)
    out = np.zeros((h, w), bool)
    if len(c) < 3:
        return out
    y, x = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for (ax, ay), (bx, by) in zip(c, np.roll(c, -1, axis=0)):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9
    return inside


def shared_area(points: np.ndarray, h: int, w: int) -> float:
    """Share of the image inside the hull; 0 for fewer than three points."""
    return float(hull_mask(points, h, w).mean()) if len(points) >= 3 and h * w else 0.0


def batch_vectors(out: np.ndarray) -> np.ndarray:
    """A model's output as one row per item: the first token of sequences, means over image maps."""
    out = np.asarray(out)
    if out.ndim == 1:
        return out[None]
    if out.ndim == 3:
        return out[:, 0]
    if out.ndim == 4:
        return out.mean(axis=(2, 3))
    return out.reshape(len(out), -1)


def match_features(a: dict, b: dict, verify: Callable[[np.ndarray, np.ndarray], np.ndarray] = agreeing, *, least_area: float = 0.01, least_points: int = 20) -> dict:
    """Matched points of two images and their shared areas.

    Features are ``points, descriptors, shape`` and, for a mirrored reading,
    ``flip_points, flip_descriptors``.  ``verify`` gives the rows that agree
    geometrically.  The mirrored reading is tried only where the larger area
    is below ``least_area``, and taken where its own is larger.
    """
    def one(points: np.ndarray, desc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        m = chain_matches(desc, b["descriptors"])
        p, q = points[m[:, 0]], b["points"][m[:, 1]]
        ok = verify(p, q) if len(m) else np.zeros(0, int)
        p, q = p[ok], q[ok]
        return p, q, shared_area(p, *a["shape"]), shared_area(q, *b["shape"])

    best, flipped = one(a["points"], a["descriptors"]), False
    if max(best[2:]) < least_area and a.get("flip_descriptors") is not None:
        other = one(a["flip_points"], a["flip_descriptors"])
        if max(other[2:]) > max(best[2:]):
            best, flipped = other, True
    p, q, sa, sb = best
    match = min(sa, sb) >= least_area if sa > 0 and sb > 0 else len(p) >= least_points
    return {"is_match": bool(match), "is_flipped": flipped, "matched_keypoints": len(p), "shared_area_a": sa, "shared_area_b": sb, "points_a": p, "points_b": q}


def match_masks(match: dict, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The matched regions of both images, empty for fewer than three points."""
    return tuple(hull_mask(p, *s) if len(p) >= 3 else np.zeros(s, bool) for p, s in ((match["points_a"], shape_a), (match["points_b"], shape_b)))
