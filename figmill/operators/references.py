"""References to records that do not exist.

Parent keys become sorted integers compressed into contiguous runs; each
reference is matched as-of to the run that starts last at or before it and is
an orphan where its key lies beyond the end of that run.  Keys that are texts
are taken by a 64-bit hash, and the run keeps its texts so that a match is
confirmed exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.functions.keys import article_digits, base_name, has_extension, instant, path_key, status_key, utc_instant, without_extension
from figmill.operators.runs import as_of, compress
from figmill.plans.lineage import cut

#: Buckets of hashed keys: the hash's upper bits, as hashes are spread over all 64 bits.
HASH_BUCKET_BITS = 48


def orphan_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (space, name) of ``references`` that ``parents`` lacks.

    Both have the columns ``space`` and ``name`` (texts).  Names of digits only
    (up to 18) are integers as they are, others go by their hash.  NULL names
    refer to nothing.  References are made distinct before the shuffle, so a
    name that a third of all rows refer to is matched once.
    """
    def keyed(df: DataFrame) -> DataFrame:
        plain = F.col("name").rlike("^(0|[1-9][0-9]{0,17})$")
        return df.where("name is not null").select("space", "name").distinct().select(
            "space", "name", plain.alias("plain"), F.when(plain, F.col("name").cast("bigint")).otherwise(F.xxhash64("name")).alias("k"))

    refs, pars = keyed(references), keyed(parents)
    left = []
    for plain, bits, extra in ((True, 16, ()), (False, HASH_BUCKET_BITS, ("witnesses",))):
        r, p = refs.where(F.col("plain") == plain), pars.where(F.col("plain") == plain)
        runs = compress(p, "k", ("space",), witness=None if plain else "name", bits=bits)
        m = as_of(r.select("space", "k", "name"), "k", runs, ("space",), extra, bits=bits)
        missing = ~F.col("covered") if plain else ~(F.col("covered") & F.coalesce(F.array_contains("witnesses", F.col("name")), F.lit(False)))
        left.append(m.where(missing).select("space", "name"))
    return left[0].unionByName(left[1])


def figure_references(figures: DataFrame) -> DataFrame:
    """All references of figures rows: ``ref_field, row_no, received_at, space, name``."""
    f = figures.select("row_no", "received_at", article_digits(F.col("pmcid")).alias("a"), path_key(F.col("href"), F.col("pmcid")).alias("h"), path_key(F.col("file_path"), F.col("pmcid")).alias("p"))
    f = f.where("a is not null").withColumn("hb", base_name(F.col("h")))
    refs = F.array(
        F.struct(F.lit("pmcid").alias("ref_field"), F.lit("article").alias("space"), F.regexp_replace("a", "^0+(?=.)", "").alias("name")),
        F.struct(F.lit("file_path").alias("ref_field"), F.lit("path").alias("space"), F.concat_ws("|", "a", F.when(F.col("p").isNotNull(), F.col("p"))).alias("name")),
        F.struct(F.lit("href").alias("ref_field"), F.when(has_extension(F.col("hb")), "base").otherwise("stem").alias("space"), F.concat_ws("|", "a", F.col("hb")).alias("name")),
    )
    out = f.select("row_no", "received_at", "p", "h", F.explode(refs).alias("r")).select("row_no", "received_at", "p", "h", "r.*")
    given = (F.col("ref_field") == "pmcid") | ((F.col("ref_field") == "file_path") & F.col("p").isNotNull()) | ((F.col("ref_field") == "href") & F.col("h").isNotNull())
    return out.where(given).select("ref_field", "row_no", "received_at", "space", "name")


def live_targets(articles: DataFrame, package_files: DataFrame) -> DataFrame:
    """What references may point at: ``space, name`` of live articles and members."""
    a = articles.select(F.regexp_replace(article_digits(F.col("pmcid")), "^0+(?=.)", "").alias("name"), F.struct(
        F.coalesce(instant(F.col("updated_at")), utc_instant(articles, "received_at")).alias("at"), (-F.col("row_no")).alias("neg"), status_key(F.col("status")).alias("status")).alias("state"))
    live = a.where("name is not null").groupBy("name").agg(F.max("state").alias("state")).where(~F.col("state.status").eqNullSafe("REMOVED")).select(F.lit("article").alias("space"), "name")
    m = package_files.where("deleted_at is null").select(article_digits(F.col("pmcid")).alias("a"), path_key(F.col("member_path"), F.col("pmcid")).alias("p")).where("a is not null and p is not null")
    m = m.withColumn("b", base_name(F.col("p")))
    names = F.array(F.struct(F.lit("path").alias("space"), F.concat_ws("|", "a", "p").alias("name")), F.struct(F.lit("base").alias("space"), F.concat_ws("|", "a", "b").alias("name")),
                    F.struct(F.lit("stem").alias("space"), F.concat_ws("|", "a", without_extension(F.col("b"))).alias("name")))
    return live.unionByName(m.select(F.explode(names).alias("t")).select("t.space", "t.name"))


def orphan_references(figures: DataFrame, articles: DataFrame, package_files: DataFrame) -> DataFrame:
    """References of figures that lead nowhere: ``ref_field, row_no, received_at``.

    Null or blank fields refer to nothing; rows without an article id are not
    judged; a target counts however late it arrives; an empty parent table
    makes every reference an orphan.
    """
    # paths are parsed once; each table is read by several steps
    refs, targets = cut(figure_references(figures), "references"), cut(live_targets(articles, package_files).distinct(), "targets")
    return refs.join(orphan_keys(refs, targets), ["space", "name"], "left_semi").select("ref_field", "row_no", "received_at")


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphans per field and period of received_at (a null time is its own period)."""
    return orphans.groupBy("ref_field", F.date_trunc(period, "received_at").alias("period")).agg(F.count(F.lit(1)).alias("orphans"))
