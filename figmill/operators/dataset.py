"""Building data sets: joins of files with references, operations, upserts and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.functions import geometry as G
from figmill.functions.text import is_thumbnail
from figmill.operators import boxes as B

#: Pairs of a part and a panel of one image that one task looks at.
PAIRS = 1 << 30

#: Extensions tried in turn for a reference that names none.
EXTENSIONS = ["jpg", "jpeg", "png", "tif", "tiff", "gif", "webp"]


def stem_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two lists of stems with what each side lacks: ``keys, state`` (both, left, right)."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("state"))


def first_by_extension(files: DataFrame, key: list[str], ext: str, order: list[str] = EXTENSIONS) -> DataFrame:
    """One file per key: the first by a preference among extensions, then by path."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in order]), F.lower(ext)), F.lit(0))
    rank = F.when(place == 0, len(order) + 1).otherwise(place)
    return files.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(rank, "path"))).where("_n = 1").drop("_n")


def match_references(refs: DataFrame, files: DataFrame, package: str, ident: str, ref: str, path: str) -> DataFrame:
    """``ident, path, how``: the file a reference means inside its package.

    Tried in turn: the full path, the path plus an extension, the base name, the
    base name plus an extension; the smallest path where several fit.
    """
    # one equi-join on all spellings of a file, the best step kept by an aggregate
    base, bare = F.regexp_replace("path", r"^.*/", ""), lambda c: F.regexp_replace(c, r"(.)\.[^./]+$", "$1")
    f = files.select(F.col(package).alias("p"), F.col(path).alias("path")).distinct().withColumn("b", base)
    names = F.array(F.struct(F.col("path").alias("k"), F.lit(1).alias("s")), F.struct(bare(F.col("path")).alias("k"), F.lit(2).alias("s")), F.struct(F.col("b").alias("k"), F.lit(3).alias("s")), F.struct(bare(F.col("b")).alias("k"), F.lit(4).alias("s")))
    offered = f.select("p", "path", F.explode(names).alias("n")).select("p", "path", "n.k", "n.s").groupBy("p", "k", "s").agg(F.min("path").alias("path"))
    r = refs.where(F.col(ref).isNotNull()).select(F.col(package).alias("p"), F.col(ident).alias("id"), F.col(ref).alias("r"))
    wanted = F.array(F.struct(F.col("r").alias("k"), F.array(F.lit(1), F.lit(2)).alias("steps")), F.struct(F.regexp_replace("r", r"^.*/", "").alias("k"), F.array(F.lit(3), F.lit(4)).alias("steps")))
    asked = r.select("p", "id", F.explode(wanted).alias("w")).select("p", "id", "w.k", F.explode("w.steps").alias("s"))
    hit = asked.join(offered, ["p", "k", "s"]).groupBy("id").agg(F.min(F.struct("s", "path")).alias("m"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("path", "path+ext", "base", "base+ext")]), F.col("m.s"))
    return hit.select(F.col("id").alias(ident), F.col("m.path").alias("path"), how.alias("how"))


def manifest(refs: DataFrame, files: DataFrame, package: str, key: str, name: str) -> DataFrame:
    """References against files: ``extracted``, ``missing``, and files that are ``thumbnail`` or ``unreferenced``."""
    r = refs.where(F.col(key).isNotNull()).select(package, key).distinct().withColumn("ref", F.lit(True))
    f = files.where(F.col(key).isNotNull()).groupBy(package, key).agg(F.min(name).alias("name"))
    state = F.when(F.col("ref") & F.col("name").isNotNull(), "extracted").when(F.col("ref"), "missing").when(is_thumbnail(F.col("name")), "thumbnail").otherwise("unreferenced")
    return r.join(f, [package, key], "full").select(package, key, state.alias("state"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Area common to boxes ``x1, y1, x2, y2``; shapes are broadcast."""
    w = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    return np.maximum(w, 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)


def _best_in_groups(box: list[np.ndarray], parts: np.ndarray, na: np.ndarray, panels: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
    """``part, panel, common`` of many small images: all pairs of each, the first of the best panels."""
    of, k = B.ranges(na * nb)
    a, b = parts[of] + k // nb[of], panels[of] + k % nb[of]
    common = _common([v[a] for v in box], [v[b] for v in box])
    first = np.flatnonzero(k % nb[of] == 0)
    best = np.maximum.reduceat(common, first)
    hit = np.flatnonzero(common == np.repeat(best, nb[of[first]]))
    hit = hit[np.searchsorted(hit, first)]
    return a[hit], b[hit], best


def _best_of_many(box: list[np.ndarray], parts: np.ndarray, panels: np.ndarray, block: int = 256, chunk: int = 1024) -> tuple[np.ndarray, ...]:
    """``_best_in_groups`` of one image of very many boxes: parts near each other against the panels around them.

    Panels are gone through in order; a part that lies whole in one needs no other.
    """
    x, y = (((box[i][parts] + box[i + 2][parts]) / 2) // 128 for i in (0, 1))
    parts = parts[np.lexsort((y, x))]
    there, best, top = [v[panels] for v in box], np.full(len(parts), -1), np.zeros(len(parts))
    for i in range(0, len(parts), block):
        open_ = np.arange(i, min(i + block, len(parts)))
        own = [v[parts[open_]] for v in box]
        size = (own[2] - own[0]) * (own[3] - own[1])
        near = np.flatnonzero((there[2] > own[0].min()) & (there[0] < own[2].max()) & (there[3] > own[1].min()) & (there[1] < own[3].max()))
        for k in range(0, len(near), chunk):
            at = near[k:k + chunk]
            common = _common([v[:, None] for v in own], [v[at] for v in there])
            j = common.argmax(axis=1)
            most = common[np.arange(len(j)), j]
            more = most > top[open_]
            top[open_[more]], best[open_[more]] = most[more], panels[at[j[more]]]
            left = top[open_] < size
            open_, size, own = open_[left], size[left], [v[left] for v in own]
            if not len(open_):
                break
    found = best >= 0
    return parts[found], best[found], top[found]


def best_panel(parts: DataFrame, panels: DataFrame, image: str, part: str, panel: str, least: float = 0.20) -> DataFrame:
    """``image, part, panel, share``: the panel that covers most of each part's box, if it covers at least a share.

    Ties go to the smaller panel.  The parts of an image of very many boxes are
    dealt to several tasks, each with all panels of the image.
    """
    sound = lambda df: df.where("x2 > x1 and y2 > y1")
    coords = [F.col(c).cast("double").alias(c) for c in G.Box._fields]
    a = sound(parts).select(image, F.lit(1).alias("_side"), F.col(part).alias("_part"), *coords)
    b = sound(panels).select(image, F.lit(0).alias("_side"), F.col(panel).alias("_panel"), *coords)
    both = a.unionByName(b, allowMissingColumns=True).where(F.col(image).isNotNull())
    sizes = both.groupBy(image).agg(F.sum("_side").alias("_a"), F.sum(1 - F.col("_side")).alias("_b"))
    # at most one for every thousand rows
    wide = F.broadcast(sizes.withColumn("_n", F.ceil(F.col("_a") * F.col("_b") / PAIRS).cast("int")).where("_n > 1").select(image, "_n"))
    dealt = F.when(F.col("_side") == 1, F.array(F.pmod(F.xxhash64("_part", "x1", "y1", "x2", "y2"), F.col("_n")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))
    both = both.join(wide, image, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_slice", F.explode(dealt)).drop("_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in B.whole_groups(batches, [image, "_slice"]):
            box, side = B.numbers(t, list(G.Box._fields), np.float64), t.column("_side").to_numpy()
            nb = np.diff(np.append(starts, t.num_rows))
            na = np.add.reduceat(side, starts).astype(np.int64)
            nb = nb - na
            some = (na > 0) & (nb > 0)
            few = some & (na * nb <= B.FEW ** 2)
            got = [_best_in_groups(box, (starts + nb)[few], na[few], starts[few], nb[few])] if few.any() else []
            got += [_best_of_many(box, np.arange(starts[g] + nb[g], starts[g] + nb[g] + na[g]), np.arange(starts[g], starts[g] + nb[g])) for g in np.flatnonzero(some & ~few)]
            if not got:
                continue
            i, j, common = (np.concatenate(c) for c in zip(*got))
            share = common / ((box[2] - box[0]) * (box[3] - box[1]))[i]
            ok = (common > 0) & (share >= least)
            i, j = pa.array(i[ok]), pa.array(j[ok])
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(k).combine_chunks() for c, k in ((image, i), ("_part", i), ("_panel", j))), pa.array(share[ok])], names=[image, part, panel, "share"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    # panels before parts, in their order
    d = both.repartition(image, "_slice").sortWithinPartitions(image, "_slice", "_side", "_panel")
    return d.mapInArrow(run, f"`{image}` {kinds[image]}, `{part}` {kinds['_part']}, `{panel}` {kinds['_panel']}, share double")


def operation_type(assigned: DataFrame, instance: list[str], panel: str) -> DataFrame:
    """``hybrid`` (several panels, one of them with several parts), ``inter``, ``intra``, ``single`` or ``unassigned``."""
    per = assigned.groupBy(*instance, panel).agg(F.count(F.lit(1)).alias("parts"))
    g = per.groupBy(*instance).agg(F.count(panel).alias("panels"), F.max(F.when(F.col(panel).isNotNull(), F.col("parts"))).alias("most"), F.array_sort(F.collect_list(panel)).alias("panels_involved"))
    kind = F.when(F.col("panels") == 0, "unassigned").when((F.col("panels") >= 2) & (F.col("most") >= 2), "hybrid").when(F.col("panels") >= 2, "inter").when(F.col("most") >= 2, "intra").otherwise("single")
    return g.select(*instance, "panels_involved", kind.alias("op_type"))


def map_labels(rows: DataFrame, label: str, mapping: dict[str, str], skip: set[str]) -> DataFrame:
    """Labels mapped to targets with the reason a row is left out: ``target, reason``."""
    target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(label)), F.col(label)) if mapping else F.col(label)
    out = rows.withColumn("target", target)
    listed = lambda c: c.isin(sorted(skip)) if skip else F.lit(False)
    reason = F.when(listed(F.col(label)), "skipped_input").when(F.col("target").isNull(), "no_target").when(listed(F.col("target")), "skipped_target").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("target", F.when(F.col("reason") == "ok", F.col("target")))


def upsert(current: DataFrame, incoming: DataFrame, key: str, kept: list[str], order: list[Column]) -> DataFrame:
    """Current rows updated from the newest incoming ones; new keys get the next sequence numbers.

    ``kept`` columns (and ``seq``) stay as they are for known keys; other columns
    take the incoming value, or keep theirs where it is NULL.
    """
    from figmill.operators.scans import numbered

    new = incoming.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    cols = [c for c in current.columns if c not in (key, "seq")]
    fresh = numbered(new.join(current.select(key), key, "left_anti"), [F.col(key)], "_add")
    top = current.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    # one row by construction
    added = fresh.join(F.broadcast(top), F.lit(True)).select(key, (F.col("top") + F.col("_add")).cast("bigint").alias("seq"), *cols)
    inc = new.select(key, *[F.col(c).alias(f"_i_{c}") for c in cols])
    old = current.join(inc, key, "left").select(key, F.col("seq").cast("bigint").alias("seq"), *[F.col(c) if c in kept else F.coalesce(F.col(f"_i_{c}"), F.col(c)).alias(c) for c in cols])
    return old.unionByName(added)


def pending(articles: DataFrame, statuses: list[str]) -> DataFrame:
    """Articles still to be worked on, by sequence number, date and id."""
    return articles.where(F.upper(F.trim("status")).isin([s.upper() for s in statuses])).orderBy(F.col("seq").asc_nulls_last(), "pub_date", "pmcid")


def report(articles: DataFrame, figures: DataFrame, key: str, order: str = "row_no") -> DataFrame:
    """One line per article: journal of its first row, first year, and how many figures rows and figures it has.

    Both tables are aggregated by ``key`` before they meet; articles without
    figures have zeros, figures without an article no line.
    """
    f = figures.groupBy(key).agg(F.count(F.lit(1)).alias("figures"), F.count_distinct("figure_id").alias("ids"))
    t = articles.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("journal", order).alias("journal"), F.min("pub_year").cast("int").alias("year"))
    return t.join(f, key, "left").select(key, "journal", "year", F.coalesce("figures", F.lit(0)).alias("figures"), F.coalesce("ids", F.lit(0)).alias("ids"))


def paper_documents(articles: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """One nested document per article with its figures in order."""
    f = figures.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("figure_id", "href", "caption", "file_path"))).alias("figures"))
    rest = [c for c in articles.columns if c != key]
    return articles.join(f, key, "left").select(key, F.struct(*rest).alias("article"), F.coalesce("figures", F.array()).alias("figures"))


def parse_record(record: Column) -> Column:
    """Id with its prefix, year and strict open-access flag of a JSON record; NULL fields where it is cut off."""
    j = F.try_parse_json(record)
    ident = F.upper(F.trim(F.try_variant_get(j, "$.pmcid", "string")))
    ident = F.when(ident.startswith("PMC"), ident).when(ident.isNotNull(), F.concat(F.lit("PMC"), ident))
    return F.struct(ident.alias("pmcid"), F.try_variant_get(j, "$.pubYear", "string").try_cast("int").alias("year"), (F.try_variant_get(j, "$.isOpenAccess", "string") == "Y").alias("open_access"))
