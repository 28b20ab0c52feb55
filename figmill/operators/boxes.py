"""Kernels over the boxes of one image, as Arrow streams sorted by image.

Small groups of a batch are worked on together; a group of very many boxes (an
image with a third of all detections) is cut into pieces first, or swept on its
own, so that neither time nor memory goes with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes beyond which a group is cut into pieces; boxes up to which groups are swept together.
MANY, FEW = 2_000, 64


def changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places of the rows whose keys differ from those of the row before; NULL equals NULL."""
    n = t.num_rows
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, n - 1)
        new |= pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the first row of each, from batches sorted by the keys."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        starts = changes(t, keys)
        fresh = not held or len(changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t.slice(0, 1)]), keys)) > 0
        last = int(starts[-1]) if len(starts) else 0
        if held and (fresh or last):
            done = pa.concat_tables([*held, t.slice(0, last)]).combine_chunks()
            yield done, np.concatenate(([0], changes(done, keys)))
            held = []
        elif last:
            yield t.slice(0, last), np.concatenate(([0], starts[:-1]))
        held.append(t.slice(last))
    if held:
        done = pa.concat_tables(held).combine_chunks()
        yield done, np.concatenate(([0], changes(done, keys)))


def numbers(t: pa.Table, names: list[str], kind=np.int64) -> list[np.ndarray]:
    return [t.column(c).to_numpy().astype(kind, copy=False) for c in names]


def crowded(boxes: DataFrame, by: list[str], many: int | None = None) -> DataFrame:
    """``by`` of the groups of more than ``many`` boxes; at most one for every ``many`` rows."""
    return boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (many or MANY)).select(*by)


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 0 .. sum(counts): which count a place belongs to, and its place there."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


# -- disjoint boxes of the same pixels ------------------------------------------

def islands(covered: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> tuple[np.ndarray, ...]:
    """``left, right, y1, y2`` of the runs along y of a grid of cells between edges."""
    step = np.diff(np.pad(covered.view(np.int8), ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(step == 1)
    b = np.nonzero(step == -1)[1]
    return ex[i], ex[i + 1], ey[a], ey[b]


def corners(shape: tuple[int, int], x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Differences along both axes of the number of boxes over each cell."""
    size, at = shape[0] * shape[1], lambda x, y: x * shape[1] + y
    plus = np.bincount(np.concatenate((at(x1, y1), at(x2, y2))), minlength=size)
    return (plus - np.bincount(np.concatenate((at(x1, y2), at(x2, y1))), minlength=size)).astype(np.int32).reshape(shape)


def over(diff: np.ndarray) -> np.ndarray:
    """The cells that a box covers, from their differences."""
    np.cumsum(diff, axis=0, out=diff)
    np.cumsum(diff, axis=1, out=diff)
    return diff[:-1, :-1] > 0


def grid_union(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Boxes of one group as disjoint ones, cut at all their left and right edges."""
    ex, ey = np.unique(np.concatenate((x1, x2))), np.unique(np.concatenate((y1, y2)))
    place = [np.searchsorted(e, v) for e, v in ((ex, x1), (ey, y1), (ex, x2), (ey, y2))]
    return islands(over(corners((len(ex), len(ey)), *place)), ex, ey)


def sweep_union(group: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Boxes of many small groups as disjoint ones: ``group, left, right, y1, y2``, in that order."""
    wide, low = 1 << 33, 1 << 32
    e = np.unique(np.concatenate((group * wide + (x1 + low), group * wide + (x2 + low))))
    first = np.searchsorted(e, group * wide + (x1 + low))
    box, k = ranges(np.searchsorted(e, group * wide + (x2 + low)) - first)
    strip = first[box] + k
    order = np.lexsort((y2[box], y1[box], strip))
    strip, box = strip[order], box[order]
    start, end = strip * wide + (y1[box] + low), strip * wide + (y2[box] + low)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    strip, box, top = strip[new], box[new], np.maximum.reduceat(end, new) - low
    return group[box], e[strip] % wide - low, e[strip + 1] % wide - low, y1[box], top - strip * wide


def unions(t: pa.Table, starts: np.ndarray, done: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Boxes of whole groups as disjoint ones, sorted by ``group, left, y1``; those of groups that are ``done`` are disjoint already."""
    x1, y1, x2, y2 = numbers(t, ["x1", "y1", "x2", "y2"])
    sizes = np.diff(np.append(starts, t.num_rows))
    group = np.repeat(np.arange(len(starts)), sizes)
    done = np.zeros(len(group), bool) if done is None else done
    few = (sizes <= FEW)[group] & ~done
    parts = [(group[done], x1[done], x2[done], y1[done], y2[done])]
    if few.any():
        parts.append(sweep_union(*(v[few] for v in (group, x1, y1, x2, y2))))
    for g in np.flatnonzero((sizes > FEW) & ~done[starts]):
        rows = slice(starts[g], starts[g] + sizes[g])
        got = grid_union(x1[rows], y1[rows], x2[rows], y2[rows])
        parts.append((np.full(len(got[0]), g), *got))
    if len(parts) == 2 and not len(parts[0][0]):
        return parts[1]
    out = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((out[3], out[1], out[0]))
    return tuple(c[order] for c in out)


def pieces(b: DataFrame, width: int, height: int | None) -> DataFrame:
    """Boxes cut at the edges of tiles ``px, py`` (without a height, of strips), each relative to its tile."""
    cells = lambda lo, hi, n: F.explode(F.sequence(F.floor(F.col(lo) / n), F.floor((F.col(hi) - 1) / n)))
    inside = lambda c, p, n: F.least(F.greatest(F.col(c) - F.col(p) * n, F.lit(0)), F.lit(n)).cast("bigint").alias(c)
    rest = [c for c in b.columns if c not in ("x1", "y1", "x2", "y2")]
    b = b.withColumn("px", cells("x1", "x2", width))
    b = b.withColumn("py", cells("y1", "y2", height)) if height else b.withColumn("py", F.lit(0).cast("bigint"))
    ys = [inside("y1", "py", height), inside("y2", "py", height)] if height else ["y1", "y2"]
    return b.select(*rest, "px", "py", inside("x1", "px", width), inside("x2", "px", width), *ys)


def tiles(cut: DataFrame, by: list[str], width: int, height: int, out: str, rows: Callable) -> DataFrame:
    """``rows(px, py, covered)`` of each tile of boxes cut by ``pieces``, after ``by``; a tile holds its counts only, however many boxes it has."""
    keys = [*by, "px", "py"]
    schema = cut.select(*by).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, diff = None, None

        def close() -> pa.RecordBatch:
            got = rows(last["px"][0].as_py(), last["py"][0].as_py(), over(diff))
            n = len(next(iter(got.values())))
            own = last.select(by).take(pa.array(np.zeros(n, np.int64)))
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), *(pa.array(v, pa.int64()) for v in got.values())], names=[*by, *got])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            x1, y1, x2, y2 = numbers(t, ["x1", "y1", "x2", "y2"])
            cuts = [0, *changes(t, keys).tolist(), t.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if last is None or i or len(changes(pa.concat_tables([last, t.slice(0, 1)]), keys)):
                    if last is not None:
                        yield close()
                    diff = np.zeros((width + 1, height + 1), np.int32)
                last = t.slice(i, 1)
                diff += corners(diff.shape, x1[i:j], y1[i:j], x2[i:j], y2[i:j])
        if last is not None:
            yield close()

    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{names}, {out}")
