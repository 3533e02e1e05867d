"""Boxes, angles, polygons and homographies as column expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 without a union."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def clamped(box: tuple[Column, ...], width: float, height: float, pad: float = 0.0) -> tuple[Column, ...]:
    """The box, padded by a share of its size, within the frame."""
    dx, dy = (box[2] - box[0]) * pad, (box[3] - box[1]) * pad
    fit = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(top)))
    return fit(box[0] - dx, width), fit(box[1] - dy, height), fit(box[2] + dx, width), fit(box[3] + dy, height)


def bottom_centre(box: tuple[Column, ...]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, box[3]


def wrapped_modulo(angle: Column) -> Column:
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def wrapped_atan2(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def projected(h: list[list[float]], x: Column, y: Column, eps: float = 1e-12) -> tuple[Column, Column]:
    """The point under a 3 x 3 homography; null where the denominator is next to 0."""
    den = x * h[2][0] + y * h[2][1] + h[2][2]
    good = F.abs(den) >= eps
    return tuple(F.when(good, (x * r[0] + y * r[1] + r[2]) / den) for r in h[:2])


def _solved(image: np.ndarray, world: np.ndarray) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(image, world, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def _off(h: np.ndarray, image: np.ndarray, world: np.ndarray) -> np.ndarray:
    """Distance of each projected point from where it belongs; infinite where it has no projection."""
    p = np.c_[image, np.ones(len(image))] @ h.T
    good = np.abs(p[:, 2]) > 1e-12
    return np.where(good, np.hypot(*(p[:, :2] / np.where(good, p[:, 2], 1.0)[:, None] - world).T), np.inf)


@lru_cache(maxsize=256)
def _fours(n: int, tries: int, seed: int) -> np.ndarray:
    """The fours of n pairs that `tries` seeded draws give, each once, in order of their first draw."""
    four = np.random.default_rng(seed).random((tries, n)).argsort(1)[:, :4]
    return four[np.sort(np.unique(np.sort(four, 1), axis=0, return_index=True)[1])]


def _through_fours(image: np.ndarray, world: np.ndarray) -> np.ndarray:
    """The homographies through four pairs each, (..., 4, 2): (..., 3, 3), of greatest entry 1; zero where three points are on a line.

    Point 4 in terms of the other three gives each plane's own coordinates; the map goes from the one to the other.
    """

    def base(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.concatenate([p, np.ones((*p.shape[:-1], 1))], -1)
        across = np.stack([np.cross(q[..., (k + 1) % 3, :], q[..., (k + 2) % 3, :]) for k in range(3)], -2)
        return q[..., :3, :], across, (across * q[..., 3:, :]).sum(-1)

    _q, across, own = base(image)
    q, _across, other = base(world)
    scale = np.stack([other[..., k] * own[..., (k + 1) % 3] * own[..., (k + 2) % 3] for k in range(3)], -1)
    h = np.swapaxes(q * scale[..., None], -1, -2) @ across
    most = np.abs(h).max((-1, -2), keepdims=True)
    return h / np.where(most > 0, most, 1.0)


def agreeing(image: np.ndarray, world: np.ndarray, ransac: float, tries: int = 500, seed: int = 0) -> np.ndarray:
    """Of many groups of n pairs each, (groups, n, 2): which pairs are within ransac of the fit to four pairs that has the most of them."""
    n, out = image.shape[1], np.zeros(image.shape[:2], bool)
    four = _fours(n, tries, seed)
    step = max(1, 200_000 // (len(four) * n))
    for at in range(0, len(image), step):
        a, b = image[at : at + step], world[at : at + step]
        h = _through_fours(a[:, four], b[:, four]).reshape(len(a), -1, 3)
        p = (h @ np.swapaxes(np.concatenate([a, np.ones((*a.shape[:2], 1))], -1), 1, 2)).reshape(len(a), len(four), 3, n)
        w = p[:, :, 2]
        off = (p[:, :, 0] - b[:, None, :, 0] * w) ** 2 + (p[:, :, 1] - b[:, None, :, 1] * w) ** 2
        near = (off <= (ransac * w) ** 2) & (np.abs(w) > 1e-12)
        out[at : at + step] = near[np.arange(len(a)), near.sum(2).argmax(1)]
    return out


def fitted(image: np.ndarray, world: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h, off) of many groups of n pairs each: the homographies fitted to the pairs inside, and all pairs' residuals; NaN for fewer than four inside."""
    h, count = np.full((len(image), 3, 3), np.nan), inside.sum(1)
    order = np.argsort(~inside, 1, kind="stable")
    for k in np.unique(count[count >= 4]):
        at = np.flatnonzero(count == k)
        (x, y), (u, v) = (np.moveaxis(np.take_along_axis(p[at], order[at, :k, None], 1), -1, 0) for p in (image, world))
        one, zero = np.ones_like(x), np.zeros_like(x)
        rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)], 1)
        own = np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3)
        last = own[:, 2:, 2:]
        h[at] = own / np.where(np.abs(last) > 1e-12, last, 1.0)
    p = np.concatenate([image, np.ones((*image.shape[:2], 1))], -1) @ np.swapaxes(h, 1, 2)
    good = np.abs(p[..., 2]) > 1e-12
    d = p[..., :2] / np.where(good, p[..., 2], 1.0)[..., None] - world
    return h, np.where(good, np.hypot(d[..., 0], d[..., 1]), np.inf)


def homography(image: list[tuple[float, float]], world: list[tuple[float, float]], ransac: float | None = None, tries: int = 500, seed: int = 0) -> tuple[list[list[float]], dict[str, float]]:
    """The homography of at least four point pairs (a handful, so on the driver) and its residuals over all pairs.

    ransac: pairs further off than this are outliers; of `tries` seeded fits to four pairs the one with the most others within
    it is chosen, and fitted anew to those.  `inliers` counts them (all pairs without ransac).
    """
    if len(image) < 4 or len(image) != len(world):
        raise ValueError("at least four pairs")
    a, b = np.array(image, float), np.array(world, float)
    inside = np.ones(len(a), bool)
    if ransac is not None:
        inside = agreeing(a[None], b[None], ransac, tries, seed)[0]
        if inside.sum() < 4:
            raise ValueError("no four pairs agree")
    h = _solved(a[inside], b[inside])
    off = _off(h, a, b)
    return h.tolist(), {"mean": float(off.mean()), "median": float(np.median(off)), "max": float(off.max()), "inliers": int((off <= ransac).sum()) if ransac is not None else len(a)}


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            crossings += (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int")
    return crossings % 2 == 1
