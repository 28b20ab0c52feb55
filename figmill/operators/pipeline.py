"""From detections and judged pairs to one annotation per figure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.operators import components, detections, masks
from figmill.plans.lineage import cut


def group_masks(groups: DataFrame, panel_runs: DataFrame) -> DataFrame:
    """Instance masks: the union of the panels of each group: ``figure_id, group_no, start, len``.

    ``groups`` has ``figure_id, group_no, node``; ``panel_runs`` has ``figure_id, panel, start, len``.
    """
    j = panel_runs.join(groups.select("figure_id", "group_no", F.col("node").alias("panel")), ["figure_id", "panel"])
    return masks.union(j.select("figure_id", "group_no", "start", "len"), ["figure_id", "group_no"])


def figure_groups(dets: DataFrame, matches: DataFrame, *, w, h, min_area_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """``figure_id, kind`` of every figure that has detections, and ``figure_id, group_no, node`` of those of several panels, staged."""
    kinds = detections.figure_kind(dets, "figure_id", w=w, h=h, min_area_share=min_area_share, sizes=dets)
    multi = kinds.where("kind = 'compound_multi'").select("figure_id")
    m = matches.select("figure_id", "a", "b").join(multi, "figure_id", "left_semi")
    sep = "\u0001"
    named = m.select(F.concat_ws(sep, "figure_id", "a").alias("a"), F.concat_ws(sep, "figure_id", "b").alias("b"))
    c = components.label_components(named)
    part = lambda col, i: F.element_at(F.split(F.col(col), sep), i)
    c = c.select(part("node", 1).alias("figure_id"), part("node", 2).alias("node"), part("root", 2).alias("root"))
    numbers = components.listed_groups(c, ["figure_id"]).select("figure_id", "root", "group_no")
    return kinds, cut(c.join(numbers, ["figure_id", "root"]).select("figure_id", "group_no", "node"), "groups")


def _with_kind(kinds: DataFrame, texts: DataFrame) -> DataFrame:
    return kinds.join(texts, "figure_id", "left").select("figure_id", "kind", F.coalesce("annotation", F.lit(masks.AUTHENTIC)).alias("annotation"))


def figure_annotations(dets: DataFrame, matches: DataFrame, panel_runs: DataFrame, *, w, h, min_area_share: float = 0.0) -> DataFrame:
    """``figure_id, kind, annotation`` of every figure that has detections.

    Only figures of several panels are searched; all others, and those without a
    match, are ``authentic``.  Groups are numbered by falling size, then first
    panel, and their masks follow in that order.
    """
    kinds, groups = figure_groups(dets, matches, w=w, h=h, min_area_share=min_area_share)
    runs = group_masks(groups, panel_runs).groupBy("figure_id", "group_no").agg(F.collect_list(F.struct("start", "len")).alias("runs"))
    return _with_kind(kinds, masks.annotation(runs, ["figure_id"], number="group_no"))


def box_annotations(dets: DataFrame, matches: DataFrame, panel_boxes: DataFrame, height: int, *, w, h, min_area_share: float = 0.0) -> DataFrame:
    """``figure_annotations`` for panels that are boxes ``figure_id, panel, x1, y1, x2, y2``: no run is shuffled."""
    kinds, groups = figure_groups(dets, matches, w=w, h=h, min_area_share=min_area_share)
    own = panel_boxes.join(groups.withColumnRenamed("node", "panel"), ["figure_id", "panel"])
    return _with_kind(kinds, masks.annotations_of_boxes(own, ["figure_id"], "group_no", height))


def fuse_figures(instances: DataFrame, height: int, width: int, **limits) -> DataFrame:
    """Smaller masks joined to the instances of their figure: ``figure_id, mask_no, runs``.

    ``instances`` has ``figure_id, origin`` (inter or intra), ``mask_no`` and
    ``runs``.  The order matters, so a figure's masks are folded in one task; a
    figure holds as many as it has panels.
    """
    def dense(runs) -> np.ndarray:
        m = np.zeros(height * width, bool)
        for r in runs:
            m[r["start"]:r["start"] + r["len"]] = True
        return m.reshape(width, height).T

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("mask_no")
        inter = {int(n): dense(r) for n, r in zip(p.mask_no[p.origin == "inter"], p.runs[p.origin == "inter"])}
        out = masks.fuse(inter, [dense(r) for r in p.runs[p.origin == "intra"]], **limits)
        rows = []
        for n, m in sorted(out.items()):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], m.T.ravel().view(np.int8), [0]))))
            rows.append((pdf.figure_id.iloc[0], n, [{"start": int(a), "len": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]))
        return pd.DataFrame(rows, columns=["figure_id", "mask_no", "runs"])

    return instances.groupBy("figure_id").applyInPandas(fold, "figure_id string, mask_no int, runs array<struct<start:bigint,len:bigint>>")


def instance_statistics(mask_rows: DataFrame, height: int, width: int) -> DataFrame:
    """Per mask: pixels, share, regions, boundary pixels and compactness, from ``path, mask_no, runs``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, n, runs in zip(pdf["path"], pdf["mask_no"], pdf["runs"]):
                m = np.zeros(height * width, bool)
                for r in runs:
                    m[r["start"]:r["start"] + r["len"]] = True
                m = m.reshape(width, height).T
                edge, size = int(masks.boundary(m).sum()), int(m.sum())
                rows.append((p, int(n), size, size / m.size, len(masks.regions(m)), edge, 4 * np.pi * size / edge**2 if edge else 0.0))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "mask_no", "pixels", "share", "regions", "boundary", "compactness"])

    return mask_rows.select("path", "mask_no", "runs").mapInPandas(run, "path string, mask_no int, pixels bigint, share double, regions int, boundary int, compactness double")
