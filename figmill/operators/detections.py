"""Panel detections: filters, suppression, ranking, crops and figure kinds.

A detection is a row with an image column, ``x1, y1, x2, y2, conf, class_id`` and
a row number that breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.functions import geometry as G
from figmill.operators import boxes as B
from figmill.operators.scans import numbered_in_groups


def keep_classes(dets: DataFrame, ids: list[int] | None) -> DataFrame:
    return dets if ids is None else dets.where(F.col("class_id").isin(sorted(set(ids))))


def class_tokens(tokens: list[str] | None, names: dict[int, str]) -> list[int] | None:
    """Class ids of a list of ids and names, in order, each once; an unknown one is an error."""
    if not tokens:
        return None
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    by_name = {key(v): k for k, v in names.items()}
    out: list[int] = []
    for t in tokens:
        k = int(t) if str(t).strip().lstrip("-").isdigit() else by_name.get(key(str(t)))
        if k is None or k not in names:
            raise ValueError(f"unknown class {t!r}")
        if k not in out:
            out.append(k)
    return out


def _order(sort: str, row: str) -> list[Column]:
    b = G.box()
    first = {"conf_desc": [F.col("conf").desc()], "area_desc": [G.area(b).desc()], "yx": [F.col("y1"), F.col("x1")], "as_is": []}[sort]
    return [*first, F.col(row)]


def top_per_class(dets: DataFrame, image: str, k: int, row: str = "row_no") -> DataFrame:
    w = W.partitionBy(image, "class_id").orderBy(F.col("conf").desc(), row)
    return dets.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def postprocess(dets: DataFrame, image: str, *, w, h, min_area: float | None = None, min_area_share: float | None = None, max_area: float | None = None, max_area_share: float | None = None,
                min_aspect: float | None = None, max_aspect: float | None = None, per_class: int | None = None, sort: str = "conf_desc", top: int | None = None, row: str = "row_no") -> DataFrame:
    """Area and aspect filters, then the best per class, then the order, then the first ``top`` per image (``place`` from 1)."""
    b = G.box()
    area, whole = G.area(b), (w if isinstance(w, Column) else F.lit(w)) * (h if isinstance(h, Column) else F.lit(h))
    ok = F.lit(True)
    if min_area is not None:
        ok = ok & (area >= min_area)
    if min_area_share is not None:
        ok = ok & (area >= whole * min_area_share)
    if max_area is not None:
        ok = ok & (area <= max_area)
    if max_area_share is not None:
        ok = ok & (area <= whole * max_area_share)
    ratio = G.width(b) / (G.height(b) + 1e-9)
    if min_aspect is not None:
        ok = ok & (ratio >= min_aspect)
    if max_aspect is not None:
        ok = ok & (ratio <= max_aspect)
    out = dets.where(ok)
    if per_class is not None:
        out = top_per_class(out, image, per_class, row)
    out = out.withColumn("place", F.row_number().over(W.partitionBy(image).orderBy(*_order(sort, row))))
    return out if top is None else out.where(F.col("place") <= top)


def assign_ids(dets: DataFrame, image: str, order: str = "yx", row: str = "row_no") -> DataFrame:
    """``panel_id`` from 0 per image in reading, confidence, area or given order."""
    b = G.box()
    keys = {"yx": ["y1", "x1"], "conf_desc": [F.col("conf").desc(), "y1", "x1"], "area_desc": [G.area(b).desc(), "y1", "x1"], "as_is": []}[order]
    return numbered_in_groups(dets, [image], [*[k if isinstance(k, Column) else F.col(k) for k in keys], F.col(row)], "panel_id", start=0)


class _Kept:
    """Kept boxes of one group, in the order they were kept."""

    def __init__(self):
        self.boxes, self.n = np.empty((16, 4)), 0
        self.rows: list[list] = []

    def first_over(self, x1: float, y1: float, x2: float, y2: float, threshold: float) -> int:
        """The first kept box that the box overlaps by more than the threshold; -1 for none."""
        k = self.boxes[:self.n]
        inter = np.maximum(0, np.minimum(k[:, 2], x2) - np.maximum(k[:, 0], x1)) * np.maximum(0, np.minimum(k[:, 3], y2) - np.maximum(k[:, 1], y1))
        size = np.maximum(0, k[:, 2] - k[:, 0]) * np.maximum(0, k[:, 3] - k[:, 1])
        over = inter / (size + max(0.0, x2 - x1) * max(0.0, y2 - y1) - inter + 1e-9) > threshold
        i = int(over.argmax()) if self.n else 0
        return i if self.n and over[i] else -1

    def add(self, x1: float, y1: float, x2: float, y2: float) -> None:
        if self.n == len(self.boxes):
            self.boxes = np.vstack((self.boxes, np.empty_like(self.boxes)))
        self.boxes[self.n] = x1, y1, x2, y2
        self.n += 1


def _suppressing(keys: int, threshold: float, merge: bool):
    """Arrow stream over boxes sorted by group and falling confidence; columns: keys, ident, conf, box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, done, schema = None, _Kept(), [], None

        def close() -> None:
            # a merged box is the confidence-weighted mean of itself and those it took
            for r in kept.rows:
                w = r[-1] + 1e-9
                done.append([*r[:-5], *(v / w for v in r[-5:-1])])

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key, (conf, x1, y1, x2, y2) = row[:keys], row[-5:]
                if key != current:
                    if merge:
                        close()
                    current, kept = key, _Kept()
                i = kept.first_over(x1, y1, x2, y2, threshold)
                if i < 0:
                    kept.add(x1, y1, x2, y2)
                    if merge:
                        kept.rows.append([*row[:-4], x1 * conf, y1 * conf, x2 * conf, y2 * conf, conf])
                    else:
                        done.append(row)
                elif merge:
                    r = kept.rows[i]
                    for j, v in enumerate((x1 * conf, y1 * conf, x2 * conf, y2 * conf, conf)):
                        r[j - 5] += v
            if done:
                yield out(done)
                done = []
        if merge:
            close()
            if done:
                yield out(done)

    return run


def suppress(dets: DataFrame, image: str, threshold: float, *, by_class: bool = True, merge: bool = False, row: str = "row_no") -> DataFrame:
    """Greedy suppression: a box goes where a better kept one overlaps it by more than ``threshold``.

    With ``merge`` the kept box becomes the confidence-weighted mean of itself
    and those it took.  Null and NaN conf never count.  A group is read as a
    stream in falling confidence and only its kept boxes are held.
    """
    keys = [image, "class_id"] if by_class else [image]
    rest = [] if by_class else ["class_id"]
    d = dets.where("conf is not null and not isnan(conf)").select(*keys, *rest, row, "conf", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    sorted_ = d.repartition(*keys).sortWithinPartitions(*keys, F.col("conf").desc(), row)
    return sorted_.mapInArrow(_suppressing(len(keys), threshold, merge), d.schema)


def from_raw(pred: DataFrame, image: str, *, conf: float, classes: list[int] | None = None, row: str = "row_no") -> DataFrame:
    """Raw detector rows (centre, size, ``obj``, ``probs``) as detections; logits are squashed where an image has values outside 0..1."""
    low, high = F.least(F.col("obj"), F.array_min("probs")), F.greatest(F.col("obj"), F.array_max("probs"))
    # one row per image, aggregated before the shuffle
    logit = pred.groupBy(F.col(image).alias("_image")).agg(((F.min(low) < 0) | (F.max(high) > 1)).alias("_logit"))
    p = pred.join(logit, F.col(image).eqNullSafe(F.col("_image"))).drop("_image")
    sig = lambda c: 1 / (1 + F.exp(-c))
    p = p.withColumn("obj", F.when(F.col("_logit"), sig(F.col("obj"))).otherwise(F.col("obj"))).withColumn("probs", F.when(F.col("_logit"), F.transform("probs", sig)).otherwise(F.col("probs")))
    p = p.withColumn("conf", F.col("obj") * F.array_max("probs")).withColumn("class_id", (F.array_position(F.col("probs"), F.array_max("probs")) - 1).cast("int")).where(F.col("conf") >= conf)
    b = G.from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    out = p.select(image, F.col(row), "class_id", "conf", *[c.alias(n) for c, n in zip(b, G.Box._fields)])
    return keep_classes(out, classes)


def figure_kind(dets: DataFrame, image: str, *, w, h, margin: int | None = None, min_area_share: float = 0.0, sizes: DataFrame | None = None) -> DataFrame:
    """``image, kind, n_panels``: several panels, one at the edge (simple), one inside, or none (unknown, for images of ``sizes`` only)."""
    b = G.upright(G.clip(G.box(), w, h))
    whole = (w if isinstance(w, Column) else F.lit(w)) * (h if isinstance(h, Column) else F.lit(h))
    ok = dets.where(G.area(b) / whole >= min_area_share) if min_area_share > 0 else dets
    g = ok.groupBy(image).agg(F.count(F.lit(1)).alias("n_panels"), F.bool_or(G.touches_edge(b, w, h, G.edge_margin(w, h, margin))).alias("edge"))
    if sizes is not None:
        g = sizes.select(image).distinct().join(g, image, "left").withColumn("n_panels", F.coalesce("n_panels", F.lit(0)))
    kind = F.when(F.col("n_panels") >= 2, "compound_multi").when(F.col("n_panels") == 0, "unknown").when(F.col("edge"), "simple").otherwise("compound_single")
    return g.select(image, "n_panels", kind.alias("kind"))


def _nearest(lo: np.ndarray, hi: np.ndarray, own: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Per box of one image the greatest ``edge`` up to its ``own`` among boxes that overlap it from ``lo`` to ``hi``; -inf for none.

    Boxes are painted over their span in order of their edge, so that what is
    seen in a span is the last one painted there.
    """
    out, ok = np.full(len(lo), -np.inf), lo < hi
    at = np.unique(np.concatenate((lo[ok], hi[ok])))
    seen = np.full(len(at), -np.inf)
    a, b = np.searchsorted(at, lo).tolist(), np.searchsorted(at, hi).tolist()
    painted, asked = np.flatnonzero(ok & ~np.isnan(edge)), np.flatnonzero(ok & ~np.isnan(own))
    painted, asked = painted[np.argsort(edge[painted], kind="stable")], asked[np.argsort(own[asked], kind="stable")]
    before, edges, k, top = np.searchsorted(edge[painted], own[asked], side="right").tolist(), edge.tolist(), 0, np.maximum.reduce
    painted = painted.tolist()
    for i, n in zip(asked.tolist(), before):
        for j in painted[k:n]:
            seen[a[j]:b[j]] = edges[j]
        k = max(k, n)
        out[i] = top(seen[a[i]:b[i]])
    return out


def _nearest_in_groups(first: np.ndarray, sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """``_nearest`` of the boxes of many small images, image after image, each box against all of its own."""
    n = sizes[np.repeat(np.arange(len(sizes)), sizes)]
    a, k = B.ranges(n)
    b = np.repeat(first, sizes)[a] + k
    a = (first[:, None] + np.arange(sizes.max(initial=0)))[np.arange(sizes.max(initial=0)) < sizes[:, None]][a]
    ok = (np.minimum(hi[a], hi[b]) > np.maximum(lo[a], lo[b])) & (edge[b] <= own[a])
    return np.maximum.reduceat(np.where(ok, edge[b], -np.inf), np.cumsum(n) - n)


def context_limits(dets: DataFrame, image: str, *, gap: float = 0.0, row: str = "row_no") -> DataFrame:
    """Per detection the nearest neighbour edges in four directions: ``lim_x1, lim_y1, lim_x2, lim_y2``.

    A neighbour counts when it overlaps on the other axis and lies wholly beside
    the box.  An image is worked on in one task, its boxes in order of their
    edges, so that many boxes cost no pairs.
    """
    sides = {"lim_x1": ("y1", "y2", "x1", "x2", 1), "lim_y1": ("x1", "x2", "y1", "y2", 1), "lim_x2": ("y1", "y2", "x2", "x1", -1), "lim_y2": ("x1", "x2", "y2", "y1", -1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in B.whole_groups(batches, [image]):
            box = dict(zip(G.Box._fields, B.numbers(t, list(G.Box._fields), np.float64)))
            sizes = np.diff(np.append(starts, t.num_rows))
            named = t.column(image).is_valid().to_numpy()[starts]  # boxes of no image have no neighbours
            few = named & (sizes <= B.FEW)
            small = np.repeat(few, sizes)
            limits = []
            for lo, hi, own, edge, sign in sides.values():
                v = [box[lo], box[hi], sign * box[own], sign * box[edge]]
                found = np.full(t.num_rows, -np.inf)
                if few.any():
                    found[small] = _nearest_in_groups(starts[few], sizes[few], *v)
                for g in np.flatnonzero(named & ~few):
                    rows = slice(starts[g], starts[g] + sizes[g])
                    found[rows] = _nearest(*(x[rows] for x in v))
                limits.append(pa.array(np.where(np.isneginf(found), 0.0, found + gap) if sign > 0 else -(found + gap)))
            yield pa.RecordBatch.from_arrays([t.column(image).combine_chunks(), t.column(row).combine_chunks(), *limits], names=[image, row, *sides])

    d = dets.select(image, row, *[F.col(c).cast("double").alias(c) for c in G.Box._fields])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(image, row).schema.fields)
    out = d.repartition(image).sortWithinPartitions(image).mapInArrow(run, f"{schema}, {', '.join(f'{n} double' for n in sides)}")
    return out.select(image, row, "lim_x1", "lim_y1", "lim_x2", "lim_y2")


def crop_score(mode: str = "area_conf", area_exp: float = 1.0, conf_exp: float = 1.0) -> Column:
    a, c = F.greatest(G.area(G.box()), F.lit(0.0)), F.greatest(F.col("conf"), F.lit(0.0))
    return {"area": F.pow(a, F.lit(area_exp)), "conf": F.pow(c, F.lit(conf_exp))}.get(mode, F.pow(a, F.lit(area_exp)) * F.pow(c, F.lit(conf_exp)))


def ranked_crops(dets: DataFrame, image: str, batch: int = 100, mode: str = "area_conf", row: str = "row_no") -> DataFrame:
    """Crops ranked inside their class by score, area, confidence, image and row; ``batch`` of them a folder."""
    d = dets.withColumn("score", crop_score(mode))
    # classes are few and each holds many rows, so they are numbered over ranges
    d = numbered_in_groups(d, ["class_id"], [F.col("score").desc(), G.area(G.box()).desc(), F.col("conf").desc(), F.col(image), F.col(row)], "rank")
    return d.withColumn("folder", F.floor((F.col("rank") - 1) / batch).cast("int"))


def image_metrics(dets: DataFrame, image: str, *, w, h) -> DataFrame:
    """Per image: boxes, area sum and maximum as shares, confidence mean and maximum, classes, and a quality score."""
    share = G.area(G.box()) / ((w if isinstance(w, Column) else F.lit(w)) * (h if isinstance(h, Column) else F.lit(h)))
    return dets.groupBy(image).agg(F.count(F.lit(1)).alias("n"), F.sum(share).alias("area_sum"), F.max(share).alias("area_max"), F.avg("conf").alias("conf_mean"), F.max("conf").alias("conf_max"), F.count_distinct("class_id").alias("classes"))


def quality(weights: dict[str, float]) -> Column:
    """Weighted sum of image metrics, the count by its logarithm."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + (F.log1p("n") if name == "n" else F.col(name)) * weight
    return total


def image_bucket(any_det: Column, any_kept: Column, filtered: bool) -> Column:
    if not filtered:
        return F.when(any_det, "has_objects").otherwise("no_objects")
    return F.when(any_kept, "kept").when(any_det, "ignored").otherwise("no_objects")


def in_bucket_order(images: DataFrame, bucket: str, score: str, path: str) -> DataFrame:
    """Place of each image in its bucket, by falling score, then path."""
    return numbered_in_groups(images, [bucket], [F.col(score).desc(), F.col(path)], "index_in_bucket", start=0)


def detect(raw: DataFrame, image: str, *, w, h, conf: float = 0.25, iou: float = 0.45, classes: list[int] | None = None, by_class: bool = True, keep: list[int] | None = None, dedup: float | None = None, order: str = "yx", **limits) -> DataFrame:
    """Raw detector rows to numbered panels: threshold, suppression, classes to keep, duplicates, limits, ids."""
    d = suppress(from_raw(raw, image, conf=conf, classes=classes), image, iou, by_class=by_class)
    d = keep_classes(d, keep)
    if dedup:
        d = suppress(d, image, dedup, merge=True)
    return assign_ids(postprocess(d, image, w=w, h=h, **limits).drop("place"), image, order)


def merge_tiles(dets: DataFrame, image: str, *, merge: float = 0.6, dedup: float = 0.9, row: str = "row_no") -> DataFrame:
    """Detections of tiles (with their origin ``tile_x, tile_y``) as detections of the image, seen twice or cut ones merged."""
    b = G.shift(G.box(), F.col("tile_x"), F.col("tile_y"))
    moved = dets.select(image, row, "class_id", "conf", *[c.cast("double").alias(n) for c, n in zip(b, G.Box._fields)])
    once = suppress(moved, image, merge, by_class=False, merge=True, row=row)
    return suppress(once, image, dedup, merge=True, row=row)
