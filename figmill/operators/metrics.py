"""Classification, score-curve, retrieval and mask metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.functions.text import first_bin, safe_div, transform_name
from figmill.operators.scans import numbered, numbered_in_groups, ordered_parts, running
from figmill.plans.lineage import cut


def confusion(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts tp, fp, tn, fn of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return rows.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def classification_metrics(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """The usual figures of a binary classifier; 0 where a share has no cases, so fpr is 1 without negatives."""
    c = confusion(rows, truth, pred, by)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    n = F.col("n").cast("double")
    c = (c.withColumn("accuracy", safe_div(tp + tn, n)).withColumn("precision", safe_div(tp, tp + fp)).withColumn("recall", safe_div(tp, tp + fn)).withColumn("tnr", safe_div(tn, tn + fp))
         .withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("fpr", 1 - F.col("tnr")).withColumn("fnr", safe_div(fn, fn + tp))
         .withColumn("predicted_match_rate", safe_div(tp + fp, n)).withColumn("prevalence", safe_div(tp + fn, n)).withColumn("npv", safe_div(tn, tn + fn)).withColumn("f1_neg", safe_div(2 * tn, 2 * tn + fp + fn)))
    denom = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    chance = safe_div((tp + fp) * (tp + fn), n * n) + safe_div((tn + fn) * (tn + fp), n * n)
    return (c.withColumn("macro_f1", (F.col("f1") + F.col("f1_neg")) / 2).withColumn("balanced_accuracy", (F.col("recall") + F.col("tnr")) / 2)
            .withColumn("mcc", F.when(denom == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(denom))).withColumn("kappa", safe_div(F.col("accuracy") - chance, 1 - chance)).withColumn("gmean", F.sqrt(F.col("recall") * F.col("tnr"))))


def _points(rows: DataFrame, truth: str, score: str, row: str) -> DataFrame:
    """One row per distinct finite score with the counts up to the first row of its ties, in input order.

    Scores are aggregated before any sort, so ties of a third of all rows are one row.
    """
    ok = rows.select(F.when(F.col(truth) > 0, 1).otherwise(0).alias("t"), F.col(score).cast("double").alias("score"), F.col(row).alias("r")).where("score is not null and not isnan(score) and abs(score) < double('infinity')")
    g = ok.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("p"), F.min(F.struct("r", "t")).alias("f")).select("score", "n", "p", F.col("f.t").alias("first"))
    order = [F.col("score").desc()]
    run = running(ordered_parts(g, order), order, sums={"cn": F.col("n"), "cp": F.col("p")})
    total = g.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # one row by construction
    run = run.join(F.broadcast(total), F.lit(True)).where("pos > 0 and pos < total").withColumn("neg", F.col("total") - F.col("pos"))
    tp = F.col("cp") - F.col("p") + F.col("first")
    seen = F.col("cn") - F.col("n") + 1
    return run.select("score", "pos", "neg", tp.alias("tp"), (seen - tp).alias("fp"))


def precision_recall(rows: DataFrame, truth: str, score: str, row: str, points: DataFrame | None = None) -> DataFrame:
    """``threshold, recall, precision``: one point per distinct score and the anchor (0, 1) at infinity; nothing for one class."""
    p = _points(rows, truth, score, row) if points is None else points
    out = p.select(F.col("score").alias("threshold"), (F.col("tp") / F.col("pos")).alias("recall"), (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"))
    anchor = p.limit(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return anchor.unionByName(out)


def roc(rows: DataFrame, truth: str, score: str, row: str, points: DataFrame | None = None) -> DataFrame:
    """``threshold, fpr, tpr``: one point per distinct score and the anchor (0, 0)."""
    p = _points(rows, truth, score, row) if points is None else points
    out = p.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))
    anchor = p.limit(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return anchor.unionByName(out)


def _previous(parts: DataFrame, order, names: list[str]) -> DataFrame:
    """Adds prev_<name> of the row before, across ranges."""
    last = parts.groupBy("_part").agg(*[F.max_by(n, F.struct(*[F.col(c) for c in order])).alias(f"_l_{n}") for n in names])
    w = W.orderBy("_part")
    last = last.select((F.lead("_part").over(w)).alias("_part"), *[f"_l_{n}" for n in names]).where("_part is not null")
    inner = W.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(last), "_part", "left")
    for n in names:
        out = out.withColumn(f"prev_{n}", F.coalesce(F.lag(n).over(inner), F.col(f"_l_{n}")))
    return out


def area_under(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area over the points in order of x (then y); 0 for fewer than two points."""
    parts = ordered_parts(curve.select(F.col(x).alias("x"), F.col(y).alias("y")), [F.col("x"), F.col("y")])
    return _previous(parts, ["x", "y"], ["x", "y"]).agg(F.coalesce(F.sum((F.col("x") - F.col("prev_x")) * (F.col("y") + F.col("prev_y")) / 2), F.lit(0.0)).alias("area"))


def average_precision(rows: DataFrame, truth: str, score: str, row: str, points: DataFrame | None = None) -> DataFrame:
    """Precision envelope (running maximum from the right) times the steps in recall."""
    pts = precision_recall(rows, truth, score, row, points)
    order = [F.col("recall"), F.col("threshold").desc()]
    parts = running(ordered_parts(pts, order), order, tops={"envelope": F.col("precision")})
    prev = _previous(parts.withColumn("neg", -F.col("threshold")), ["recall", "neg"], ["recall"])
    return prev.agg(F.sum((F.col("recall") - F.col("prev_recall")) * F.col("envelope")).alias("average_precision"))


def score_summary(rows: DataFrame, truth: str, score: str, row: str) -> DataFrame:
    """AP, ROC area and the first best thresholds by F1 and by balanced accuracy."""
    p = points = cut(_points(rows, truth, score, row), "points")
    prec, rec = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("pos"))
    p = p.withColumn("f1", F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)).withColumn("ba", 0.5 * (rec + (F.col("neg") - F.col("fp")) / F.greatest(F.lit(1), F.col("neg"))))
    best = p.agg(F.max(F.struct("f1", "score")).alias("a"), F.max(F.struct("ba", "score")).alias("b")).select(
        F.col("a.score").alias("best_f1_threshold"), F.col("a.f1").alias("best_f1"), F.col("b.score").alias("best_balanced_threshold"), F.col("b.ba").alias("best_balanced_accuracy"))
    ap = average_precision(rows, truth, score, row, points)
    auc = area_under(roc(rows, truth, score, row, points), "fpr", "tpr").withColumnRenamed("area", "roc_auc")
    # three single rows
    return best.join(F.broadcast(ap), F.lit(True)).join(F.broadcast(auc), F.lit(True))


def mask_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Means over rows where all columns are present; 0 where there is none."""
    full = rows.where(" and ".join(f"{c} is not null" for c in columns))
    return full.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns])


def exact_quantiles(rows: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles by name, between two values in proportion, per ``by``; NULLs take no part.

    Values are numbered in one global order over ranges, so no group meets in one
    task, however many distinct values it has.
    """
    by = by or []
    v = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    n = numbered_in_groups(v, by, [F.col("_v")], "_n", start=0) if by else numbered(v, [F.col("_v")], "_n", start=0)
    size = v.groupBy(*[F.col(b).alias(f"_k_{b}") for b in by]).agg(F.count(F.lit(1)).alias("_size"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    # the sizes are one row per group, joined with the few values next to a quantile
    at = {k: (F.col("_size") - 1) * q for k, q in shares.items()}
    near = n.join(size, same) if by else n.join(F.broadcast(size), same)
    close = F.lit(False)
    for x in at.values():
        close = close | (F.abs(F.col("_n") - x) < 1)
    near = near.where(close)
    return near.groupBy(*by).agg(*[F.sum(F.when(F.abs(F.col("_n") - x) < 1, F.col("_v") * (1 - F.abs(F.col("_n") - x)))).alias(k) for k, x in at.items()])


def _with_quantiles(sums: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return sums.join(F.broadcast(quantiles), F.lit(True), "left")  # one row
    q = quantiles.select(*[F.col(b).alias(f"_q_{b}") for b in by], *[c for c in quantiles.columns if c not in by])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_q_{b}"))
    return sums.join(q, same, "left").drop(*[f"_q_{b}" for b in by])


def retrieval_metrics(ranks: DataFrame, rank: str, ks: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """Count, mean reciprocal rank, mean, median and 95th percentile rank, and recall at each k."""
    r = F.col(rank)
    sums = ranks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(F.lit(1.0) / F.greatest(r, F.lit(1))).alias("mrr"), F.avg(r).alias("mean_rank"), *[F.avg((r <= k).cast("double")).alias(f"recall_at_{k}") for k in ks])
    return _with_quantiles(sums, exact_quantiles(ranks, rank, {"median_rank": 0.5, "p95_rank": 0.95}, by), by or [])


def by_transform(ranks: DataFrame, rank: str, transforms: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The same per transform of a query (each query counts in all of its own) and per number of transforms."""
    t = F.array_distinct(F.transform(transforms, transform_name))
    names = F.concat(t, F.array(F.concat(F.lit("n_transforms="), F.size(t).cast("string"))))
    return retrieval_metrics(ranks.withColumn("bucket", F.explode(names)), rank, ks, ["bucket"])


def by_bin(ranks: DataFrame, rank: str, value: str, bins: list[tuple[str, float, float]], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return retrieval_metrics(ranks.where(F.col(value).isNotNull()).withColumn("bin", first_bin(F.col(value), bins)), rank, ks, ["bin"])


def number_summary(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Least, greatest, mean, median and population deviation (0 for one value)."""
    sums = rows.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stdev"))
    return _with_quantiles(sums, exact_quantiles(rows, column, {"median": 0.5}, by), by or [])
