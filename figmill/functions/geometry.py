"""Boxes as column expressions.  A box is four columns x1, y1, x2, y2; x2 and y2 are exclusive."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box in columns named like x1, with a prefix and a suffix."""
    return Box(*[F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")])


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _at_least_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def width(b: Box) -> Column:
    return _at_least_zero(b.x2 - b.x1)


def height(b: Box) -> Column:
    return _at_least_zero(b.y2 - b.y1)


def area(b: Box) -> Column:
    return width(b) * height(b)


def to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, width(b), height(b)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def clip(b: Box, w, h) -> Box:
    """Into [0, w] x [0, h], ends included."""
    inside = lambda c, hi: F.least(F.greatest(c, F.lit(0.0)), _lit(hi).cast("double"))
    return Box(inside(b.x1, w), inside(b.y1, h), inside(b.x2, w), inside(b.y2, h))


def upright(b: Box) -> Box:
    """Corners swapped where they are inverted."""
    return Box(F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))


def scale(b: Box, sx, sy) -> Box:
    return Box(b.x1 * _lit(sx), b.y1 * _lit(sy), b.x2 * _lit(sx), b.y2 * _lit(sy))


def normalise(b: Box, w, h) -> Box:
    return Box(b.x1 / _lit(w), b.y1 / _lit(h), b.x2 / _lit(w), b.y2 / _lit(h))


def denormalise(b: Box, w, h) -> Box:
    return scale(b, w, h)


def shift(b: Box, dx, dy) -> Box:
    """From crop to image coordinates; negative offsets go back."""
    return Box(b.x1 + _lit(dx), b.y1 + _lit(dy), b.x2 + _lit(dx), b.y2 + _lit(dy))


def yolo(b: Box, w, h) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the image."""
    return (b.x1 + b.x2) / 2 / _lit(w), (b.y1 + b.y2) / 2 / _lit(h), (b.x2 - b.x1) / _lit(w), (b.y2 - b.y1) / _lit(h)


def yolo_line(cls: Column, b: Box, w, h, conf: Column | None = None) -> Column:
    parts = [*yolo(b, w, h)] + ([conf] if conf is not None else [])
    return F.format_string("%d" + " %.6f" * len(parts), cls.cast("int"), *[p.cast("double") for p in parts])


def unletterbox(b: Box, pad_x, pad_y, gain, w, h) -> Box:
    """From letterboxed to image coordinates, clipped to the last pixel."""
    u = Box((b.x1 - _lit(pad_x)) / _lit(gain), (b.y1 - _lit(pad_y)) / _lit(gain), (b.x2 - _lit(pad_x)) / _lit(gain), (b.y2 - _lit(pad_y)) / _lit(gain))
    return clip(u, _lit(w) - 1, _lit(h) - 1)


def axis_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return _at_least_zero(F.least(a2, b2) - F.greatest(a1, b1))


def intersection_area(a: Box, b: Box) -> Column:
    return axis_overlap(a.x1, a.x2, b.x1, b.x2) * axis_overlap(a.y1, a.y2, b.y1, b.y2)


def intersection(a: Box, b: Box) -> Column:
    """Common box as a struct; NULL where there is none."""
    i = Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    return F.when((i.x2 > i.x1) & (i.y2 > i.y1), F.struct(*[c.alias(n) for c, n in zip(i, Box._fields)]))


def iou(a: Box, b: Box) -> Column:
    """Share of the common area; 1e-9 keeps empty boxes from dividing by zero."""
    inter = intersection_area(a, b)
    return inter / (area(a) + area(b) - inter + F.lit(1e-9))


def touches_edge(b: Box, w, h, margin) -> Column:
    m = _lit(margin)
    return (b.x1 <= m) | (b.y1 <= m) | (b.x2 >= _lit(w) - m) | (b.y2 >= _lit(h) - m)


def edge_margin(w, h, fixed: int | None = None, ratio: float = 0.02, least: int = 8, most: int = 64) -> Column:
    """Margin in pixels: a share of the shorter side, rounded half to even, within limits."""
    if fixed is not None:
        return F.lit(max(0, fixed))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.least(_lit(w), _lit(h)) * F.lit(ratio)).cast("int")))


def aspect(w: Column, h: Column) -> Column:
    return w.cast("double") / F.greatest(h.cast("double"), F.lit(1.0))


def similar_shape(w1: Column, h1: Column, w2: Column, h2: Column, aspect_log: float | None = 0.9, area_ratio: float | None = 0.20) -> Column:
    """Aspects within a logarithmic tolerance and areas within a ratio; unknown sizes pass."""
    known = (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0)
    ok = F.lit(True)
    if aspect_log is not None:
        ok = ok & (F.abs(F.log(aspect(w1, h1) / aspect(w2, h2))) <= aspect_log)
    if area_ratio is not None:
        a, b = w1.cast("double") * h1, w2.cast("double") * h2
        ok = ok & (F.least(a, b) / F.greatest(a, b) >= area_ratio)
    return ~known | ok


def shrink(b: Box, by: int, w, h) -> Box:
    """Inset and clamped; the box itself where nothing would be left."""
    s = clip(Box(b.x1 + by, b.y1 + by, b.x2 - by, b.y2 - by), w, h)
    ok = (s.x2 > s.x1) & (s.y2 > s.y1)
    return Box(*[F.when(ok, x).otherwise(y) for x, y in zip(s, b)])


def of_points(points: Column) -> Column:
    """Bounding box of an array of [x, y]: minima rounded down, maxima up."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.floor(F.array_min(x)).alias("x1"), F.floor(F.array_min(y)).alias("y1"), F.ceil(F.array_max(x)).alias("x2"), F.ceil(F.array_max(y)).alias("y2"))


def pad_and_clip(b: Box, w, h, pad_px: int = 0, pad_share: float = 0.0, limits: Box | None = None) -> Column:
    """Padded integer crop box, not past the limits (nor inside the box itself); NULL where it is empty."""
    px = F.greatest(b.x2 - b.x1, F.lit(1.0)) * max(0.0, pad_share) + max(0, pad_px)
    py = F.greatest(b.y2 - b.y1, F.lit(1.0)) * max(0.0, pad_share) + max(0, pad_px)
    t = Box(b.x1 - px, b.y1 - py, b.x2 + px, b.y2 + py)
    if limits is not None:
        t = Box(F.greatest(t.x1, F.least(limits.x1, b.x1)), F.greatest(t.y1, F.least(limits.y1, b.y1)), F.least(t.x2, F.greatest(limits.x2, b.x2)), F.least(t.y2, F.greatest(limits.y2, b.y2)))
    within = lambda c, hi: F.greatest(F.lit(0), F.least(c.cast("int"), hi.cast("int")))
    w, h = _lit(w), _lit(h)
    i = Box(within(F.floor(t.x1), w - 1), within(F.floor(t.y1), h - 1), within(F.ceil(t.x2), w), within(F.ceil(t.y2), h))
    return F.when((i.x2 > i.x1) & (i.y2 > i.y1), F.struct(*[c.alias(n) for c, n in zip(i, Box._fields)]))


def near_or_overlap(a: Box, b: Box, tolerance) -> Column:
    """Whether the boxes meet once both are grown by the tolerance, ends included."""
    t = _lit(tolerance)
    return (F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + 2 * t >= 0) & (F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + 2 * t >= 0)


def fit(w: Column, h: Column, box_w, box_h) -> Column:
    """Factor that fits a size into a box."""
    return F.least(_lit(box_w) / w, _lit(box_h) / h)


def tiles(w: Column, h: Column, tile_w: int = 1024, tile_h: int = 1024, overlap: float = 0.2) -> Column:
    """Array of tile boxes over an image; the last of a row or column is moved inward."""
    def origins(size: Column, tile: int) -> Column:
        step = max(1, int(tile * (1 - overlap)))
        n = F.greatest(F.ceil((size - tile) / F.lit(step)), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(F.lit(0), F.least(size.cast("int"), (i * step + tile).cast("int")) - tile).cast("int"))

    def one(y: Column) -> Column:
        return F.transform(origins(w, tile_w), lambda x: F.struct(x.alias("x1"), y.alias("y1"), F.least(w.cast("int"), x + tile_w).alias("x2"), F.least(h.cast("int"), y + tile_h).alias("y2")))

    return F.flatten(F.transform(origins(h, tile_h), one))
