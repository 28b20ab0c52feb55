"""Masks as runs of pixels, their algebra, and the scores built on it.

A mask is an array of (start, len) with 0-based starts over a column-major
flattening (position = x * height + y).  The text form is a JSON list of 1-based
starts and lengths; several masks are joined by semicolons, and ``authentic``
stands for none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.operators import boxes as B

AUTHENTIC = "authentic"
#: Width of the strips and side of the tiles that a crowded group is cut into, in pixels; runs spelled out at a time.
STRIP, TILE, RUNS = 64, 512, 400_000


# -- text form -----------------------------------------------------------------

def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_runs(text: Column, pixels: Column | None = None) -> Column:
    """Runs of one mask's text, cut at the number of pixels; NULL where starts do not rise or the length is odd."""
    kind = "array<struct<start:bigint,len:bigint>>"

    def paired(n: Column) -> Column:
        odd = F.filter(n, lambda x, i: i % 2 == 0)
        even = F.filter(n, lambda x, i: i % 2 == 1)
        return F.when(F.size(n) == 0, F.array().cast(kind)).when(F.size(n) % 2 == 0, F.zip_with(odd, even, lambda a, b: F.struct((a - 1).alias("start"), b.alias("len"))))

    def checked(pairs: Column) -> Column:
        # each start against the end of the run before it
        rising = F.forall(F.zip_with(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), lambda b, a: b["start"] >= a["start"] + a["len"]), lambda ok: ok)
        return F.when((F.size(pairs) < 2) | rising, pairs)

    out = _let(_let(F.from_json(text, "array<bigint>"), paired), checked)
    if pixels is None:
        return out
    cut = F.transform(out, lambda p: F.struct(p["start"].alias("start"), F.least(p["len"], pixels - p["start"]).alias("len")))
    return F.filter(cut, lambda p: p["len"] > 0)


def text_of(runs: Column) -> Column:
    """Text of an array of runs, in order of start."""
    flat = F.flatten(F.transform(F.array_sort(runs), lambda r: F.array(r["start"] + 1, r["len"])))
    return F.to_json(flat)


def annotation(masks: DataFrame, by: list[str], runs: str = "runs", number: str = "mask_no", least: int = 1) -> DataFrame:
    """``by, annotation``: the texts of a case's masks in order of number, or ``authentic``."""
    size = F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, r: s + r["len"])
    item = F.when(size >= max(1, least), F.struct(F.col(number).alias("n"), text_of(F.col(runs)).alias("t")))
    texts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])
    return masks.groupBy(*by).agg(texts.alias("t")).select(*by, F.when(F.size("t") == 0, AUTHENTIC).otherwise(F.array_join("t", ";")).alias("annotation"))


# -- run algebra as rows -------------------------------------------------------

def runs_of_boxes(boxes: DataFrame, by: list[str], height: int) -> DataFrame:
    """One run per pixel column of integer boxes: ``by, start, len``; empty boxes give none."""
    b = boxes.where("x2 > x1 and y2 > y1").select(*by, F.col("y1").cast("bigint").alias("y1"), (F.col("y2") - F.col("y1")).cast("bigint").alias("len"), F.explode(F.sequence(F.col("x1").cast("bigint"), F.col("x2").cast("bigint") - 1)).alias("x"))
    return b.select(*by, (F.col("x") * height + F.col("y1")).alias("start"), "len")


def union(runs: DataFrame, by: list[str], bits: int = 16) -> DataFrame:
    """Disjoint runs that cover the same pixels, per ``by``.

    Runs are first split at multiples of 2**bits, so that a group with very many
    runs is spread over windows; runs that meet at such a multiple stay apart.
    """
    size = 1 << bits
    r = runs.where("len > 0").select(*by, "start", (F.col("start") + F.col("len")).alias("end"))
    r = r.withColumn("p", F.explode(F.sequence(F.shiftright("start", bits), F.shiftright(F.col("end") - 1, bits))))
    r = r.select(*by, "p", F.greatest("start", F.col("p") * size).alias("start"), F.least("end", (F.col("p") + 1) * size).alias("end"))
    w = W.partitionBy(*by, "p").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*by, "p", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*by, "start", (F.col("end") - F.col("start")).alias("len"))


def _sound_boxes(boxes: DataFrame, by: list[str], height: int | None = None) -> DataFrame:
    """Integer boxes that have pixels; an error where one reaches the height."""
    y2 = F.col("y2") if height is None else F.when(F.col("y2") >= height, F.raise_error(F.lit("a box reaches the height of the mask"))).otherwise(F.col("y2"))
    return boxes.where("x2 > x1 and y2 > y1").select(*by, *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2")], y2.cast("bigint").alias("y2"))


def _disjoint_boxes(boxes: DataFrame, by: list[str], height: int) -> DataFrame:
    """``by, x1, y1, x2, y2, done``: boxes of the same pixels; those of a crowded group are disjoint already, and cut into strips."""
    b = _sound_boxes(boxes, by, height)
    many = F.broadcast(B.crowded(b, by))

    def rows(px: int, py: int, covered: np.ndarray) -> dict:
        edges = np.arange(STRIP + 1) + px * STRIP
        # equal columns side by side are one box
        same = np.concatenate(([False], (covered[1:] == covered[:-1]).all(axis=1)))
        left = np.flatnonzero(~same)
        x1, _, y1, y2 = B.islands(np.ascontiguousarray(covered[left]), np.append(left, STRIP), np.arange(height + 1))
        right = np.append(left[1:], STRIP)
        return {"x1": edges[x1], "y1": y1, "x2": edges[right[np.searchsorted(left, x1)]], "y2": y2}

    cut = B.tiles(B.pieces(b.join(many, by, "left_semi"), STRIP, None), by, STRIP, height, "x1 bigint, y1 bigint, x2 bigint, y2 bigint", rows)
    return b.join(many, by, "left_anti").withColumn("done", F.lit(False)).unionByName(cut.withColumn("done", F.lit(True)))


def _runs(left: np.ndarray, right: np.ndarray, y1: np.ndarray, y2: np.ndarray, of: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of disjoint boxes sorted by ``of, left``, in order of ``of`` and start."""
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (of[1:] != of[:-1]))))
    high = np.diff(np.append(first, len(left)))
    strip, k = B.ranges((right - left)[first] * high)
    box = first[strip] + k % high[strip]
    return (left[box] + k // high[strip]) * height + y1[box], (y2 - y1)[box]


def _mask_stream(boxes: DataFrame, by: list[str], sort: list[str], height: int, schema: str, emit) -> DataFrame:
    """``emit(table, starts, of, starts of runs, lengths)`` over whole groups of ``by`` and ``sort``, a bounded number of runs at a time; all of a group of ``by`` are in one stream."""
    keys = [*by, *sort]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in B.whole_groups(batches, by):
            if sort:
                starts = np.unique(np.concatenate((starts, B.changes(t, keys))))
            of, left, right, y1, y2 = B.unions(t, starts, t.column("done").to_numpy())
            whole = np.concatenate(([0], B.changes(t.select(by).take(pa.array(starts)), by))) if sort else np.arange(len(starts))
            # groups of by are taken together while their runs are few
            per = np.add.reduceat(np.bincount(of, right - left, len(starts)), whole).astype(np.int64)
            total, ends = np.cumsum(per), np.append(whole[1:], len(starts))
            i = 0
            while i < len(whole):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + RUNS, side="right")))
                g0, g1 = whole[i], ends[j - 1]
                rows = slice(*np.searchsorted(of, [g0, g1]))
                start, size = _runs(left[rows], right[rows], y1[rows], y2[rows], of[rows], height)
                count = np.bincount(of[rows] - g0, right[rows] - left[rows], g1 - g0).astype(np.int64)
                yield from emit(t.select(keys).take(pa.array(starts[g0:g1])), whole[i:j] - g0, count, start, size)
                i = j

    d = _disjoint_boxes(boxes, keys, height)
    return d.repartition(*by).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)


def masks_of_boxes(boxes: DataFrame, by: list[str], height: int) -> DataFrame:
    """``by, runs``: the pixels of integer boxes as one array of disjoint runs; an error where a box reaches the height.

    Only what one group covers is held at a time, and runs are spelled out a
    bounded number at a time.
    """
    def emit(keys: pa.Table, _, count: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        runs = pa.ListArray.from_arrays(pa.array(_offsets(count)), pa.StructArray.from_arrays([pa.array(start), pa.array(size)], ["start", "len"]))
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keys.columns), runs], names=[*by, "runs"])

    return _mask_stream(boxes, by, [], height, f"{_types(boxes, by)}, runs array<struct<start:bigint,len:bigint>>", emit)


def _offsets(count: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(count))).astype(np.int32)


def _texts(count: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Texts of masks of ``count`` runs each."""
    flat = pa.array(np.stack((start + 1, size), axis=1).ravel()).cast(pa.string())
    inner = pc.binary_join(pa.ListArray.from_arrays(pa.array(2 * _offsets(count)), flat), ",")
    return pc.binary_join_element_wise("[", inner, "]", "")


def texts_of_boxes(boxes: DataFrame, by: list[str], height: int) -> DataFrame:
    """``by, t``: the text of the mask of each group of integer boxes, as ``text_of`` writes it."""
    def emit(keys: pa.Table, _, count: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keys.columns), _texts(count, start, size)], names=[*by, "t"])

    return _mask_stream(boxes, by, [], height, f"{_types(boxes, by)}, t string", emit)


def texts_side_by_side(boxes: DataFrame, by: list[str], number: str, values: dict[str, int], height: int) -> DataFrame:
    """``by`` and a column for each of the named values of ``number``: the text of that mask of the case, NULL without pixels; cases without any give no row."""
    def emit(keys: pa.Table, whole: np.ndarray, count: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, is_ = _texts(count, start, size), keys.column(number).to_numpy()
        case = np.repeat(np.arange(len(whole)), np.diff(np.append(whole, len(count))))
        columns = []
        for v in values.values():
            at = np.full(len(whole), -1)
            at[case[is_ == v]] = np.flatnonzero(is_ == v)
            columns.append(texts.take(pa.array(at, mask=at < 0)))
        own = keys.select(by).take(pa.array(whole))
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), *columns], names=[*by, *values])

    wanted = boxes.where(F.col(number).isin(list(values.values())))
    return _mask_stream(wanted, by, [number], height, f"{_types(boxes, by)}, {', '.join(f'`{n}` string' for n in values)}", emit)


def annotations_of_boxes(boxes: DataFrame, by: list[str], number: str, height: int) -> DataFrame:
    """``by, annotation``: what ``annotation`` gives for the masks of boxes, written where a case's boxes meet, so that no run is shuffled."""
    def emit(keys: pa.Table, whole: np.ndarray, count: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        cases = pa.ListArray.from_arrays(pa.array(np.append(whole, len(count)).astype(np.int32)), _texts(count, start, size))
        own = keys.select(by).take(pa.array(whole))
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), pc.binary_join(cases, ";")], names=[*by, "annotation"])

    return _mask_stream(boxes, by, [number], height, f"{_types(boxes, by)}, annotation string", emit)


def area_of_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """``by, pixels``: how many pixels integer boxes cover together; a crowded group is counted tile by tile."""
    b = _sound_boxes(boxes, by)
    many = F.broadcast(B.crowded(b, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in B.whole_groups(batches, by):
            of, left, right, y1, y2 = B.unions(t, starts)
            size = np.zeros(len(starts), np.int64)
            np.add.at(size, of, (right - left) * (y2 - y1))
            own = t.select(by).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), pa.array(size)], names=[*by, "pixels"])

    few = b.join(many, by, "left_anti").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"{_types(b, by)}, pixels bigint")
    cut = B.tiles(B.pieces(b.join(many, by, "left_semi"), TILE, TILE), by, TILE, TILE, "pixels bigint", lambda px, py, covered: {"pixels": np.array([covered.sum()])})
    return few.unionByName(cut.groupBy(*by).agg(F.sum("pixels").alias("pixels")))


def area(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum("len").alias("pixels"))


def bounding_box(runs: DataFrame, by: list[str], height: int) -> DataFrame:
    """Box of the pixels, x2 and y2 exclusive."""
    last = F.col("start") + F.col("len") - 1
    wraps = F.floor(F.col("start") / height) != F.floor(last / height)
    return runs.where("len > 0").groupBy(*by).agg(F.min(F.floor(F.col("start") / height)).alias("x1"), F.min(F.when(wraps, F.lit(0)).otherwise(F.col("start") % height)).alias("y1"),
                                                  (F.max(F.floor(last / height)) + 1).alias("x2"), (F.max(F.when(wraps, F.lit(height - 1)).otherwise(last % height)) + 1).alias("y2"))


def overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Per key of both sides: pixels of a, of b and common; IoU (1 when both are empty), Dice and share of a."""
    one = union(a, by).select(*by, "start", "len", F.lit(1).alias("side")).unionByName(union(b, by).select(*by, "start", "len", F.lit(2).alias("side")))
    sizes = one.groupBy(*by).agg(F.sum(F.when(F.col("side") == 1, F.col("len")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 2, F.col("len")).otherwise(0)).alias("b"))
    both = area(union(one, by), by).withColumnRenamed("pixels", "u")
    out = sizes.join(both, by).withColumn("common", F.col("a") + F.col("b") - F.col("u"))
    div = lambda x, y, empty: F.when(y == 0, F.lit(empty)).otherwise(x / y)
    return out.select(*by, "a", "b", "common", div(F.col("common"), F.col("u"), 1.0).alias("iou"), div(2 * F.col("common"), F.col("a") + F.col("b"), 1.0).alias("dice"), div(F.col("common"), F.col("a"), 0.0).alias("share"))


def paste(runs: DataFrame, by: list[str], crop_height: int, x: Column, y: Column, width: int, height: int) -> DataFrame:
    """Runs of a crop moved into the figure: each pixel column is shifted and cut at the figure's edges."""
    cols = runs.withColumn("c", F.explode(F.sequence(F.floor(F.col("start") / crop_height), F.floor((F.col("start") + F.col("len") - 1) / crop_height))))
    lo = F.greatest(F.col("start"), F.col("c") * crop_height) - F.col("c") * crop_height + y
    hi = F.least(F.col("start") + F.col("len"), (F.col("c") + 1) * crop_height) - F.col("c") * crop_height + y
    moved = cols.select(*by, (F.col("c") + x).alias("fx"), F.greatest(lo, F.lit(0)).alias("lo"), F.least(hi, F.lit(height)).alias("hi"))
    return moved.where((F.col("fx") >= 0) & (F.col("fx") < width) & (F.col("hi") > F.col("lo"))).select(*by, (F.col("fx") * height + F.col("lo")).cast("bigint").alias("start"), (F.col("hi") - F.col("lo")).cast("bigint").alias("len"))


# -- scores of one image -------------------------------------------------------

def read_mask(text: str, pixels: int) -> np.ndarray:
    """Starts and ends of a mask's text; an error where it is not well formed."""
    n = np.array(json.loads(text), np.int64)
    if len(n) % 2:
        raise ValueError("a mask needs pairs of start and length")
    start, end = n[::2] - 1, n[::2] - 1 + n[1::2]
    if (np.diff(start) < 0).any() or (start[1:] < end[:-1]).any():
        raise ValueError("runs must rise and not overlap")
    out = np.stack((start, np.minimum(end, pixels)))
    return out[:, out[1] > out[0]]


def common_pixels(a: np.ndarray, b: np.ndarray) -> int:
    """Pixels in both of two sorted disjoint lists of runs."""
    if not a.shape[1] or not b.shape[1]:
        return 0
    covered = np.concatenate(([0], np.cumsum(b[1] - b[0])))

    def below(x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(b[0], x, side="right") - 1
        j = np.maximum(i, 0)
        return np.where(i < 0, 0, covered[j] + np.minimum(x - b[0][j], b[1][j] - b[0][j]))

    return int((below(a[1]) - below(a[0])).sum())


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Assignment of least cost, one column per row (rows <= columns), by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, prev, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            gap = c[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], prev[1:][better] = gap[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[prev[j0]], prev[j0]
    cols = np.flatnonzero(match[1:])
    rows = match[1:][cols] - 1
    order = np.argsort(rows)
    return (cols[order], rows[order]) if flip else (rows[order], cols[order])


def image_score(label: str, pred: str, shape: str) -> float:
    """Mean F1 of the best assignment of predicted to true masks, times the penalty for excess predictions."""
    h, w = json.loads(shape)[:2]
    gt = [read_mask(t, h * w) for t in label.split(";")]
    pr = [read_mask(t, h * w) for t in pred.split(";")]
    f1 = np.zeros((max(len(pr), len(gt)), len(gt)))
    for i, p in enumerate(pr):
        for j, g in enumerate(gt):
            size = int((p[1] - p[0]).sum() + (g[1] - g[0]).sum())
            f1[i, j] = 2 * common_pixels(p, g) / size if size else 0.0
    rows, cols = assign(-f1)
    return float(f1[rows, cols].mean() * len(gt) / max(len(pr), len(gt)))


def case_scores(solution: DataFrame, submission: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, image_score``: 1 where both say ``authentic``, 0 where one does, else the score of the masks.

    Rows are matched by key; a case without a prediction counts as ``authentic``.
    """
    s = submission.select(F.col(key), F.col("annotation").alias("pred"))
    return paired_scores(solution.select(key, F.col("annotation").alias("label"), "shape").join(s, key, "left").withColumn("pred", F.coalesce("pred", F.lit(AUTHENTIC))), key)


def paired_scores(cases: DataFrame, key: str = "row_id") -> DataFrame:
    """``case_scores`` of cases that have ``label``, ``pred`` and ``shape`` in one row."""
    @F.pandas_udf("double")
    def scored(label: pd.Series, pred: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series([(1.0 if a == b else 0.0) if AUTHENTIC in (a, b) else image_score(a, b, s) for a, b, s in zip(label, pred, shape)], dtype="float64")

    return cases.select(key, scored("label", "pred", "shape").alias("image_score"))


def score(solution: DataFrame, submission: DataFrame, key: str = "row_id") -> DataFrame:
    return case_scores(solution, submission, key).agg(F.avg("image_score").alias("score"))


# -- dense kernels -------------------------------------------------------------

def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Every pixel within a square of the radius."""
    out = mask.astype(bool)
    for axis in (0, 1):
        grown = out.copy()
        for d in range(1, radius + 1):
            a, b = [slice(None)] * 2, [slice(None)] * 2
            a[axis], b[axis] = slice(d, None), slice(None, -d)
            grown[tuple(a)] |= out[tuple(b)]
            grown[tuple(b)] |= out[tuple(a)]
        out = grown
    return out


def erode(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Pixels whose neighbours are all set; outside the image nothing is."""
    p = np.pad(mask.astype(bool), 1)
    out = p[1:-1, 1:-1].copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy or dx) and (diagonal or not (dy and dx)):
                out &= p[1 + dy:p.shape[0] - 1 + dy, 1 + dx:p.shape[1] - 1 + dx]
    return out


def boundary(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    return mask.astype(bool) & ~erode(mask, diagonal)


def regions(mask: np.ndarray, diagonal: bool = True) -> list[dict]:
    """Connected regions by joining runs of neighbouring rows: area, box (exclusive ends) and centroid."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(bool).view(np.int8), [0]))))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = len(runs)
            runs.append((y, a, b))
            parent.append(i)
            here.append(i)
            for j in above:
                _, c, d = runs[j]
                if (a <= d and c <= b) if diagonal else (a < d and c < b):
                    parent[find(i)] = find(j)
        above = here
    groups: dict[int, list] = {}
    for i, r in enumerate(runs):
        groups.setdefault(find(i), []).append(r)
    out = []
    for g in groups.values():
        n = sum(b - a for _, a, b in g)
        out.append({"area": n, "x1": min(a for _, a, _ in g), "y1": min(y for y, _, _ in g), "x2": max(b for _, _, b in g), "y2": max(y for y, _, _ in g) + 1,
                    "cx": sum((a + b - 1) * (b - a) / 2 for _, a, b in g) / n, "cy": sum(y * (b - a) for y, a, b in g) / n})
    return sorted(out, key=lambda r: (r["y1"], r["x1"]))


def fuse(inter: dict[int, np.ndarray], intra: list[np.ndarray], *, share: float = 0.30, iou: float = 0.15, radius: int = 2, least: int = 10) -> dict[int, np.ndarray]:
    """Each smaller mask joins the instance it overlaps best, in turn, or becomes a new one."""
    out = {k: v.astype(bool) for k, v in inter.items()}
    grown = {k: dilate(v, radius) for k, v in out.items()}
    for m in intra:
        m = m.astype(bool)
        if m.sum() < least:
            continue
        d, best, top = dilate(m, radius), None, 0.0
        for k, g in grown.items():
            common = int((d & g).sum())
            if not common:
                continue
            s, i = common / max(1, int(d.sum())), common / max(1, int((d | g).sum()))
            if (s >= share or i >= iou) and max(s, i) > top:
                best, top = k, max(s, i)
        best = best if best is not None else max(out, default=0) + 1
        out[best] = out[best] | m if best in out else m
        grown[best] = dilate(out[best], radius)
    return out
