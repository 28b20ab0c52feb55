"""Which pairs of panels of one figure are worth comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.functions import geometry as G
from figmill.functions.text import panel_group


def allowed(mode: str | None = "broad", aspect_log: float | None = 0.9, area_ratio: float | None = 0.20) -> Column:
    """Whether a pair with class_name, w and h of both sides may match."""
    ok = G.similar_shape(F.col("w_a"), F.col("h_a"), F.col("w_b"), F.col("h_b"), aspect_log, area_ratio)
    return ok if mode is None else ok & (panel_group(F.col("class_name_a"), mode) == panel_group(F.col("class_name_b"), mode))


def shortlist(scored: DataFrame, group: str, k: int, ok: Column, least: float = -0.5) -> DataFrame:
    """Top-k candidates per panel, completed from the other side: ``group, a, b, score``.

    ``scored`` has each pair once, a < b, with ``score``.  First every a takes
    its best k allowed partners; then every b looks at the first max(2k, k + 5)
    of its neighbours on both sides, itself included at score -1, takes up to k
    allowed, and adds the pairs that are missing.  Ties go to the lower name.
    A score not above ``least`` means unknown.  A group's last panel has no list.
    """
    known = scored.where(F.col("score") > least).withColumn("ok", ok)
    one = known.where("ok").withColumn("n", F.row_number().over(W.partitionBy(group, "a").orderBy(F.col("score").desc(), "b"))).where(F.col("n") <= k).select(group, "a", "b", "score")
    # second pass: neighbours of every panel but the first, in order of score, before any filter
    both = scored.withColumn("ok", ok & (F.col("score") > least)).select(group, F.col("b").alias("me"), F.col("a").alias("other"), "a", "b", "score", "ok").unionByName(
        scored.withColumn("ok", ok & (F.col("score") > least)).select(group, F.col("a").alias("me"), F.col("b").alias("other"), "a", "b", "score", "ok"))
    first = scored.groupBy(group).agg(F.min("a").alias("first"))
    place = F.row_number().over(W.partitionBy(group, "me").orderBy(F.col("score").desc(), "other"))
    near = both.join(first, group).where("me <> first").withColumn("n", place)
    # the panel itself stands in the order at score -1 and takes a place
    near = near.withColumn("n", F.col("n") + F.when((F.col("score") < -1.0) | ((F.col("score") == -1.0) & (F.col("other") > F.col("me"))), 1).otherwise(0)).where(F.col("n") <= max(2 * k, k + 5))
    two = near.where("ok").withColumn("m", F.row_number().over(W.partitionBy(group, "me").orderBy("n"))).where(F.col("m") <= k).select(group, "a", "b", "score")
    return one.unionByName(two).distinct()


def stop_early(results: DataFrame, group: str, src: str, place: str, match: str, streak: int) -> DataFrame:
    """Results of each source up to where ``streak`` misses in a row end its list (0: never)."""
    if streak <= 0:
        return results
    w = W.partitionBy(group, src).orderBy(place)
    runs = results.withColumn("_hits", F.sum(F.col(match).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(group, src, "_hits").orderBy(place)
    miss = runs.withColumn("_miss", F.sum((~F.col(match)).cast("int")).over(run.rowsBetween(W.unboundedPreceding, 0)))
    ended = miss.withColumn("_end", F.min(F.when(F.col("_miss") >= streak, F.col(place))).over(W.partitionBy(group, src)))
    return ended.where(F.col("_end").isNull() | (F.col(place) <= F.col("_end"))).drop("_hits", "_miss", "_end")


def decide(is_match: Column, keypoints: Column, area_a: Column | None = None, area_b: Column | None = None, least_keypoints: int = 20, least_area: float = 0.01) -> Column:
    """Match rule: both areas known and the smaller large enough, or enough keypoints; then enough keypoints in any case."""
    if area_a is not None and area_b is not None:
        is_match = F.when((area_a > 0) & (area_b > 0), F.least(area_a, area_b) >= least_area).otherwise(keypoints >= least_keypoints)
    return is_match & (keypoints >= least_keypoints)


def match_score(area_a: Column, area_b: Column, keypoints: Column, how: str = "min") -> Column:
    """Score of a pair from the shared areas, or from its keypoints."""
    return {"min": F.least(area_a, area_b), "mean": (area_a + area_b) / 2}.get(how, keypoints.cast("double"))


def pairs_in_groups(members: DataFrame, by: list[str], member: str, block: int = 1_000) -> DataFrame:
    """``by, a, b``: all pairs a < b of each group's distinct members.

    A group is dealt into blocks, and every two blocks (and each with itself) meet
    in a row of their own, so that the pairs of a large group are written by many
    tasks and never held.
    """
    m = members.select(*by, F.col(member).alias("_m")).where("_m is not null").distinct()
    n = m.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    lists = m.join(n, by).groupBy(*by, "_n", F.pmod(F.xxhash64("_m"), F.col("_n")).cast("int").alias("_j")).agg(F.collect_list("_m").alias("_y"))
    left = lists.select(*by, F.col("_j").alias("_i"), F.col("_y").alias("_x"), F.explode(F.sequence(F.col("_j"), F.col("_n") - 1)).alias("_j"))
    met = left.join(lists.select(*by, "_j", "_y"), [*by, "_j"])
    # by number: few bytes make very many pairs
    met = met.repartition(4 * members.sparkSession.sparkContext.defaultParallelism, *by, "_i", "_j")
    p = met.select(*by, "_i", "_j", "_y", F.explode("_x").alias("_x")).select(*by, "_i", "_j", "_x", F.explode("_y").alias("_y")).where("_i < _j or _x < _y")
    return p.select(*by, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def sampled_pairs(members: DataFrame, quotas: DataFrame, group: str, ident: str, seed: int = 42) -> DataFrame:
    """About ``quota`` unordered pairs per group, in a seeded order, without listing all pairs.

    Members stand on a circle in hash order; the pairs at distance 1, 2, ... are
    taken until there are enough, and distances up to half the circle give every
    pair once.  ``place`` is the pair's position in that order.
    """
    m = members.select(group, F.col(ident).alias("i")).distinct().join(quotas, group)
    w = W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), group, "i"), "i")
    m = m.withColumn("pos", F.row_number().over(w) - 1).withColumn("size", F.count(F.lit(1)).over(W.partitionBy(group)))
    far = F.least(F.ceil(F.col("quota") / F.col("size")), F.floor(F.col("size") / 2)).cast("int")
    a = m.where("size > 1").withColumn("d", F.explode(F.sequence(F.lit(1), F.greatest(far, F.lit(1))))).where((F.col("d") * 2 < F.col("size")) | (F.col("pos") < F.col("d")))
    a = a.select(group, F.col("i").alias("x"), "d", "pos", ((F.col("pos") + F.col("d")) % F.col("size")).alias("to"), "size", "quota")
    b = m.select(group, F.col("i").alias("y"), F.col("pos").alias("to"))
    return a.join(b, [group, "to"]).select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), ((F.col("d") - 1) * F.col("size") + F.col("pos")).alias("place"), "quota")


def negative_pairs(panels: DataFrame, positives: DataFrame, group: str, ident: str, label: str, per_positive: int = 10, same_label: bool = False, seed: int = 42) -> DataFrame:
    """Pairs without a match, at most ``per_positive`` for each matched pair of the figure, in a seeded order.

    Figures without a matched pair give none.  With ``same_label`` the pairs are
    drawn inside each label of the figure.
    """
    pos = positives.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    count = pos.groupBy(group).agg(F.count(F.lit(1)).alias("pos"))
    keys = F.concat_ws("\u0001", group, F.coalesce(label, F.lit(""))) if same_label else F.col(group).cast("string")
    members = panels.select(group, ident, keys.alias("circle"))
    quotas = members.join(count, group).select("circle", ((per_positive + 1) * F.col("pos")).alias("quota")).distinct()
    drawn = sampled_pairs(members, quotas, "circle", ident, seed)
    owner = members.select(group, "circle").distinct()
    rest = drawn.join(owner, "circle").join(pos, [group, "a", "b"], "left_anti").join(count, group)
    w = W.partitionBy(group).orderBy("place", "circle")
    return rest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_positive * F.col("pos")).select(group, "a", "b")
