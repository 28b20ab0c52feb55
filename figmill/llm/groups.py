"""Consolidating pairwise matches into groups by low-diameter decomposition.

Each level draws an exponential shift per vertex; clusters start at their
centre's shifted time and grow along edges by one hop a round, a vertex going
to whichever cluster reaches it first.  Clusters are contracted to super-
vertices, the edges between clusters form the next level, and the assignments
are composed.  The expected share of cut edges falls by a constant factor per
level, so the number of levels is logarithmic in the number of edges.

Vertices are numbered once, in the order of their members, so that a vertex, a
time and a centre are one integer and its minimum is a hash aggregate.  Several
rounds of a level are one plan: the edges are shuffled by their first end once
and met again from there in each of its rounds, and only one row per vertex moves
between rounds, none of them through the driver.  A vertex with a great part of all edges is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.llm.skew import HOT_PARTS, HOT_ROWS, hot_keys, split_join
from figmill.operators.scans import numbered
from figmill.plans.lineage import cut, release

#: Rate of the exponential shifts; shifts are cut off at ROUNDS.
BETA = 0.3
#: Rounds of growth per level.
ROUNDS = 6
#: Rounds in one plan: longer plans have fewer jobs and take more of the driver's memory.
PLAN_ROUNDS = 3
#: Bits of a vertex number, and parts of a round's time that are told apart: time and centre are packed into one integer.
VERTEX_BITS, TICKS = 44, 1 << 14
_ROUND = TICKS << VERTEX_BITS


def _start(vertex: Column, level: int, beta: float, rounds: int) -> Column:
    """Time and number of a vertex as a centre; the shift comes from its hash and is the same on every attempt of a task."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    time = F.floor((F.lit(float(rounds)) - F.least(-F.log(u) / beta, F.lit(float(rounds)))) * TICKS).cast("bigint")
    return F.shiftleft(time, VERTEX_BITS) + vertex


def _grow(edges: DataFrame, hubs: list, level: int, beta: float, rounds: int) -> DataFrame:
    """One level, written: ``v, c`` with the cluster centre of every vertex of ``edges`` (``a, b`` in both directions); ``hubs`` are split."""
    part = F.lit(0)
    if hubs:
        edges = edges.withColumn("part", F.when(F.col("a").isin(hubs), F.pmod(F.xxhash64("b"), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
        part = F.explode(F.when(F.col("v").isin(hubs), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))
    start = _start(F.col("v"), level, beta, rounds)
    # best is NULL while the vertex is free, else the time its cluster reached it and the centre
    state = edges.select(F.col("a").alias("v")).distinct().select("v", F.when(start < _ROUND, start).alias("best"))
    none, staged = F.lit(None).cast("bigint"), []
    for now in range(1, rounds + 1):
        if hubs:
            met = state.withColumn("part", part).hint("shuffle_hash").join(edges.withColumnRenamed("a", "v"), ["v", "part"])
        else:
            met = state.hint("shuffle_hash").join(edges.withColumnRenamed("a", "v"), "v")
        # a vertex keeps what it has, and one that was reached in the round before makes an offer along its edges
        own = F.struct(F.col("v").alias("v"), F.col("best").alias("own"), none.alias("offer"))
        offer = F.struct(F.col("b").alias("v"), none.alias("own"), (F.col("best") + _ROUND).alias("offer"))
        rows = met.select(F.inline(F.when(F.col("best") >= (now - 1) * _ROUND, F.array(own, offer)).otherwise(F.array(own))))
        best = rows.groupBy("v").agg(F.min("own").alias("own"), F.min("offer").alias("offer"))
        begins = F.when((start >= now * _ROUND) & ((start < (now + 1) * _ROUND) | F.lit(now == rounds)), start)
        state = best.select("v", F.coalesce("own", F.least("offer", begins)).alias("best"))
        if now % PLAN_ROUNDS == 0 or now == rounds:
            state = cut(state, "state")
            release(*staged)
            staged = [state]
    out = state.select("v", F.col("best").bitwiseAND((1 << VERTEX_BITS) - 1).alias("c"))
    out._figmill_path = state._figmill_path
    return out


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", *, beta: float = BETA, rounds: int = ROUNDS, max_levels: int = 200) -> DataFrame:
    """``member, group`` for every record linked by a pair; group is its smallest member.

    Pairs may come in either order and repeat; self-pairs and pairs with a NULL
    link nothing, so their records do not appear unless another pair names them;
    an empty table gives no rows.  An error where ``max_levels`` do not end it.
    """
    spark = pairs.sparkSession
    raw = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    raw = cut(raw.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    if not raw.head(1):
        kind = raw.schema["x"].dataType.simpleString()
        return spark.createDataFrame([], f"member {kind}, group {kind}")
    # 64-bit hashes would risk collisions, so the members are numbered
    vertices = cut(numbered(raw.select(F.explode(F.array("x", "y")).alias("member")).distinct(), [F.col("member")], "v"), "vertices")
    one, two = (vertices.select(F.col("member").alias(m), F.col("v").alias(v)) for m, v in (("x", "vx"), ("y", "vy")))
    ends = split_join(split_join(raw, one, "x"), two, "y")
    edges = cut(ends.select(F.inline(F.array(F.struct(F.col("vx").alias("a"), F.col("vy").alias("b")), F.struct(F.col("vy").alias("a"), F.col("vx").alias("b"))))), "edges")
    release(raw)
    steps: list[DataFrame] = []
    sizes: list[int] = []
    while count := edges.count():
        if len(steps) >= max_levels:
            raise RuntimeError("the decomposition did not end")
        # hubs of a, and so of b, as every edge is there in both directions; fewer edges than HOT_ROWS have none
        hubs = hot_keys(edges, "a") if count >= HOT_ROWS else []
        sizes.append(count)
        step = _grow(edges, hubs, len(steps), beta, rounds)
        steps.append(step)
        first, second = step.select(F.col("v").alias("a"), F.col("c").alias("ca")), step.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        between = split_join(split_join(edges, first, "a", hot=hubs), second, "b", hot=hubs).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        before, edges = edges, cut(between, "edges")
        release(before)
    # from the last level to the first: each holds a fraction of the vertices of the one before
    root = steps[-1]
    for step, count in zip(reversed(steps[:-1]), reversed(sizes[:-1])):
        later = root.select(F.col("v").alias("c"), F.col("c").alias("r"))
        root = split_join(step, later, "c", "left", hot=None if count >= HOT_ROWS else []).select("v", F.coalesce("r", "c").alias("c"))
    mapping = cut(vertices.join(root, "v"), "mapping")
    names = mapping.groupBy("c").agg(F.min("member").alias("group"))
    release(*steps, edges, vertices)
    return split_join(mapping, names, "c").select("member", "group")
