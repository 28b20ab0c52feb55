"""Most similar vectors for every vector by a forest of hash prefixes.

Each tree gives every vector a long string of sign bits.  Sorted, the strings
form an array in which a prefix is a contiguous slice.  Every vector descends to
the shortest prefix, of its own length in each tree, whose slice holds no more
than ``slice_size`` vectors, and meets all vectors of that slice.  Then all trees
ascend together for those vectors whose neighbours may still be missing, as told
by the chance that a vector as similar as the k-th found shares a slice in none
of the trees: their slices may hold twice as many.  The number of ascents is
fixed, so time grows with the number of vectors; the recall is measured in the
tests and stated in the README.

The arrays are range-partitioned by group, tree and string, and each part is
read as a stream; a slice that reaches over the edge of a part is cut there, in
each tree at other places.  Slices are compared by matrix products, and only the
best k per vector leave a slice.  Equal vectors are one point, however many rows
have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.plans.lineage import cut, release

#: Trees, and sign bits per tree (one integer each).
TREES, BITS = 12, 62
#: Vectors a slice may hold before the first ascent, and ascents, each of which doubles it.
SLICE, ASCENTS = 2048, 1
#: Chance of missing a neighbour at which the ascent of a vector ends.
MISS = 0.02
#: Slices a part of the sorted arrays should hold.
PART_SLICES = 16
#: Decimals at which scores count as equal.
DECIMALS = 12


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Fixed random hyperplanes: dim x (trees * bits)."""
    return np.random.default_rng(seed).standard_normal((dim, trees * bits))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps squares of tiny and huge values finite
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, embedding: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite elements that are not all zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(e.isNotNull() & (F.size(e) == dim)).where(finite & F.exists(e, lambda v: v != 0))


def _hashes(dim: int, trees: int, bits: int):
    """Each point once per tree, with the whole string of that tree, the first bit the most significant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(dim, trees, bits)
        weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                codes = ((_unit(_matrix(part.column(2), dim)) @ p) > 0).reshape(part.num_rows, trees, bits) @ weights
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), trees)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.tile(np.arange(trees, dtype=np.int32), part.num_rows)), pa.array(codes.ravel()), rows.column(1), rows.column(2), rows.column(3)], names=["grp", "tree", "code", "point", "v", "ask"])

    return run


def slices(codes: np.ndarray, size: int, bits: int) -> list[tuple[int, int, int]]:
    """Begin, end and prefix length of the slices of a sorted array: the shortest prefixes that hold no more than ``size``."""
    out, todo = [], [(0, len(codes), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= size or depth == bits:
            # strings that are equal to the last bit are cut by position
            out += [(a, min(a + size, hi), depth) for a in range(lo, hi, size)]
            continue
        bit = np.int64(1) << np.int64(bits - 1 - depth)
        prefix = codes[lo] & ~(bit * 2 - 1) if depth else np.int64(0)
        mid = lo + int(np.searchsorted(codes[lo:hi], prefix | bit))
        todo += [(a, b, depth + 1) for a, b in ((mid, hi), (lo, mid)) if b > a]
    return out


def _search(k: int, dim: int, size: int, bits: int):
    """A sorted part as a stream: per asking point and tree the best k others of its slice."""

    def best(points: np.ndarray, x: np.ndarray, codes: np.ndarray, ask: np.ndarray):
        for lo, hi, depth in slices(codes, size, bits):
            if ask[lo:hi].any():
                yield depth, _nearest(points[lo:hi], x[lo:hi], ask[lo:hi], k)

    def batch(found) -> pa.RecordBatch:
        got = np.concatenate([g for _, g in found])
        level = np.concatenate([np.full(len(g), d, np.int32) for d, g in found])
        first = np.flatnonzero(np.r_[True, got["point"][1:] != got["point"][:-1]]) if len(got) else np.zeros(0, int)
        at = pa.array(np.append(first, len(got)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(got["point"][first]), pa.ListArray.from_arrays(at, pa.array(got["other"])), pa.ListArray.from_arrays(at, pa.array(got["score"])), pa.array(level[first])], names=["point", "others", "scores", "level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, rows = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            found = list(best(t.column("point").to_numpy(), _unit(_matrix(t.column("v"), dim)), t.column("code").to_numpy(), t.column("ask").to_numpy(zero_copy_only=False)))
            if found:
                yield batch(found)

        for b in batches:
            if not b.num_rows:
                continue
            group = b.column(0).dictionary_encode().indices.to_numpy()
            tree = b.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (tree[1:] != tree[:-1])])
            for lo, hi in zip(edge, np.append(edge[1:], b.num_rows)):
                now = (b.column(0)[int(lo)].as_py(), int(tree[lo]))
                # an array is kept until its end, or until it holds many slices
                if held and (now != key or rows >= PART_SLICES * size):
                    yield from flush()
                    held, rows = [], 0
                key = now
                held.append(b.slice(int(lo), int(hi - lo)))
                rows += int(hi - lo)
        if held:
            yield from flush()

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, ask: np.ndarray, k: int) -> np.ndarray:
    """The best k others of each asking point among the points of a slice."""
    order = np.argsort(ids)
    ids, x, asking = ids[order], x[order], np.flatnonzero(ask[order])
    n = len(ids)
    m = min(n, k + 8)
    out: list[np.ndarray] = [np.zeros(0, RESULT)]
    if n < 2:
        return out[0]
    rows = max(1, 4_000_000 // n)
    for a in range(0, len(asking), rows):
        at = asking[a:a + rows]
        s = x[at] @ x.T
        s[np.arange(len(at)), at] = -2.0
        if m < n:
            some = np.argpartition(-s, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(s, some, 1)
            near.sort(axis=1)
            # rows with more ties at the k-th place than were kept
            tied = near[:, 0] >= near[:, m - k] - 1e-11
        else:
            some, tied = np.broadcast_to(np.arange(n), s.shape), np.zeros(len(s), bool)
        out.append(_ranked(x[at], x, ids[at], ids, some, np.flatnonzero(~tied), k))
        for r in np.flatnonzero(tied):
            c = np.flatnonzero(s[r] >= np.partition(s[r], n - k)[n - k] - 1e-11)
            out.append(_ranked(x[at[r:r + 1]], x, ids[at[r:r + 1]], ids, c[None, :], np.zeros(1, int), k))
    return np.concatenate(out)


#: A point, another one, and their cosine.
RESULT = [("point", "i8"), ("other", "i8"), ("score", "f8")]


def _ranked(q: np.ndarray, p: np.ndarray, qi: np.ndarray, pi: np.ndarray, some: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The best k of the candidates of each row: score rounded, then the smaller id.

    Scores are summed pair by pair, so that a pair has the same score in every slice.
    """
    c = some[rows]
    exact = np.einsum("rmd,rd->rm", p[c], q[rows])
    ids = pi[c]
    exact[ids == qi[rows][:, None]] = -2.0
    place = np.lexsort((ids, -np.round(exact, DECIMALS)), axis=1)[:, :k]
    score = np.take_along_axis(exact, place, 1)
    keep = score > -1.5
    out = np.empty(int(keep.sum()), dtype=RESULT)
    out["point"] = np.broadcast_to(qi[rows][:, None], keep.shape)[keep]
    out["other"] = np.take_along_axis(ids, place, 1)[keep]
    out["score"] = score[keep]
    return out


def _merged(k: int, trees: int):
    """Lists of others and scores from all trees: the best k of each point, and the chance that the next like the k-th was missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            other, score = lists.flatten().to_numpy(), b.column(2).flatten().to_numpy()
            order = np.lexsort((other, -np.round(score, DECIMALS), row))
            row, other, score = row[order], other[order], score[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1])] if len(row) else np.zeros(0, bool)
            row, other, score = row[new], other[new], score[new]  # a pair has one score, so its repeats are neighbours
            begin = np.searchsorted(row, np.arange(b.num_rows))
            keep = np.arange(len(row)) - begin[row] < k
            row, other, score = row[keep], other[keep], score[keep]
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            full = np.diff(at) >= k
            kth = np.full(b.num_rows, -1.0)
            kth[full] = score[at[1:][full] - 1]
            share = 1 - np.arccos(np.clip(kth, -1, 1)) / np.pi
            missed = (1 - share ** b.column(3).to_numpy()) ** trees
            offsets = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(score)), b.column(3), pa.array(missed)], names=["point", "others", "scores", "level", "missed"])

    return run


def _round(points: DataFrame, before: DataFrame | None, k: int, dim: int, trees: int, bits: int, size: int) -> DataFrame:
    """One meeting of the asking points in slices of ``size``: their lists, with what was found before."""
    parts = max(1, -(-points.count() * trees // (PART_SLICES * size)))
    forest = points.mapInArrow(_hashes(dim, trees, bits), "grp string, tree int, code bigint, point bigint, v array<float>, ask boolean")
    forest = forest.repartitionByRange(parts, "grp", "tree", "code").sortWithinPartitions("grp", "tree", "code")
    lists = forest.mapInArrow(_search(k, dim, size, bits), "point bigint, others array<bigint>, scores array<double>, level int")
    if before is not None:
        lists = lists.unionByName(before.where("ask").select("point", "others", "scores", F.lit(None).cast("int").alias("level")))
    lists = lists.groupBy("point").agg(F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("scores")).alias("scores"), F.coalesce(F.avg("level"), F.lit(0.0)).alias("level"))
    return lists.mapInArrow(_merged(k, trees), "point bigint, others array<bigint>, scores array<double>, level double, missed double")


def similar_vectors(vectors: DataFrame, k: int, *, ident: str = "item_id", group: str = "index_id", embedding: str = "embedding", dim: int = 64,
                    trees: int = TREES, bits: int = BITS, slice_size: int = SLICE, ascents: int = ASCENTS, miss: float = MISS) -> DataFrame:
    """``ident, match, score, rank``: the k nearest others of every usable vector of its group.

    Nearness is the cosine in double precision; scores equal after rounding to 12
    decimals go by the smaller ident.  Vectors that are null, of another length,
    not finite or all zero take no part; NULL groups form a group; a group of
    fewer than k + 1 vectors gives what there is; equal vectors are each other's
    neighbours; a repeated ident counts once, with the vector of the smallest
    digest; an empty table gives no rows; other columns are not read.  A group of
    no more than ``slice_size`` points is searched in full.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    rows = usable(vectors, embedding, dim).select(grp.alias("grp"), F.col(ident).cast("bigint").alias("id"), F.transform(F.col(embedding), lambda v: v.cast("float") + F.lit(0.0).cast("float")).alias("v"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(",", "grp", F.transform("v", lambda x: x.cast("string"))), 256))
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("digest", "grp", "v")).alias("s")).select("id", "s.*"), "vectors")
    # equal vectors are one point, named by its smallest id
    points = cut(rows.groupBy("digest").agg(F.min("id").alias("point"), F.first("grp").alias("grp"), F.first("v").alias("v")), "points")
    member = cut(rows.select("digest", "id").join(points.select("digest", "point"), "digest").select("point", "id"), "members")
    release(rows)
    asked = points.select("grp", "point", "v")
    found = cut(_round(asked.withColumn("ask", F.lit(True)), None, k, dim, trees, bits, slice_size), "found")
    size = slice_size
    for _ in range(ascents):
        size *= 2
        weak = found.withColumn("ask", (F.col("missed") > miss) & (F.col("level") > 0))
        again = _round(asked.join(weak.where("ask").select("point", "ask"), "point", "left").select("grp", "point", "v", F.coalesce("ask", F.lit(False)).alias("ask")), weak, k, dim, trees, bits, size)
        before, found = found, cut(again.unionByName(weak.where("not ask").drop("ask")), "found")
        release(before)
    found_pairs = found.select("point", F.explode(F.arrays_zip("others", "scores")).alias("x")).select("point", F.col("x.others").alias("other"), F.col("x.scores").alias("score"))
    # ids of equal vectors beyond the k + 1 smallest are never among the nearest; thinned in salted parts first
    salted, whole = W.partitionBy("point", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"), W.partitionBy("point").orderBy("id")
    firsts = member.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1).withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1).select("point", "id")
    # one list per point: its own rows and those of its neighbours in one order
    own = firsts.select("point", F.col("id").alias("match"), F.lit(1.0).alias("score"))
    others = found_pairs.join(firsts.select(F.col("point").alias("other"), F.col("id").alias("match")), "other").select("point", "match", "score")
    w = W.partitionBy("point").orderBy(F.round("score", DECIMALS).desc(), "match")
    lists = own.unionByName(others).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).groupBy("point").agg(F.array_sort(F.collect_list(F.struct("place", "match", "score"))).alias("m"))
    out = member.join(lists, "point").select(F.col("id").alias(ident), F.slice(F.filter("m", lambda x: x["match"] != F.col("id")), 1, k).alias("m"))
    out = cut(out.select(ident, F.posexplode("m").alias("pos", "x")).select(ident, F.col("x.match").alias("match"), F.col("x.score").alias("score"), (F.col("pos") + 1).alias("rank")), "neighbours")
    release(points, member, found)
    return out
