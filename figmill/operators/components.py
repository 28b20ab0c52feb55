"""Groups of linked panels, and the graph of a figure's matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.plans.lineage import cut, release


def label_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node of each node's component.

    Alternates two steps on edges that point from larger to smaller nodes: every
    neighbour above a node is linked to the node's smallest neighbour, then every
    neighbour below it is, until a round changes no edge.  The rounds grow with
    the logarithm of the diameter.
    """
    def state(t: DataFrame) -> tuple:
        # a count and a sum of hashes tell two sets of edges apart in one pass
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = cut(e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct())
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = state(new)
        release(e)
        e = new
        if now == before:
            break
        before = now
    root = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("root", "node").alias("root"))


def listed_groups(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Groups in order of falling size, then first member; ``group_no`` from 1 (per ``by``)."""
    by = by or []
    g = members.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    if by:
        return g.withColumn("group_no", F.row_number().over(W.partitionBy(*by).orderBy(F.col("size").desc(), "first")))
    from figmill.operators.scans import numbered

    return numbered(g, [F.col("size").desc(), F.col("first")], "group_no")


def region_graph(matches: DataFrame) -> dict[str, DataFrame]:
    """Four tables of a figure's matches: panels, regions, pairs and links.

    A match has ``figure_id, panel_a, panel_b`` and what was measured; it makes one
    region, one edge between its panels, and a link from the region to each.
    """
    m = matches.withColumn("region_id", F.concat_ws("|", "figure_id", "panel_a", "panel_b"))
    panels = m.select("figure_id", F.col("panel_a").alias("panel")).unionByName(m.select("figure_id", F.col("panel_b").alias("panel"))).distinct()
    links = m.select("region_id", F.explode(F.array(F.struct(F.col("panel_a").alias("panel"), F.lit("a").alias("side")), F.struct(F.col("panel_b").alias("panel"), F.lit("b").alias("side")))).alias("l")).select("region_id", "l.*")
    return {"panels": panels, "regions": m.select("region_id", "figure_id"), "pairs": m.drop("region_id"), "links": links}


def with_box(panels: DataFrame, boxes: DataFrame, uid: str = "panel", stem=None) -> DataFrame:
    """Box of a panel by its full name, else by its name without the class part."""
    from figmill.functions.text import strip_class

    full = boxes.groupBy(F.col(uid).alias("k1")).agg(F.min("box").alias("b1"))
    loose = boxes.groupBy(strip_class(F.col(uid)).alias("k2")).agg(F.min(F.struct(F.col(uid), F.col("box"))).alias("b2"))
    p = panels.withColumn("k1", F.col(uid)).withColumn("k2", strip_class(F.col(uid)))
    return p.join(full, "k1", "left").join(loose, "k2", "left").withColumn("box", F.coalesce("b1", F.col("b2.box"))).drop("k1", "k2", "b1", "b2")
