"""Tables as files: submissions, predictions, labels, rankings and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.functions import geometry as G
from figmill.sources.files import PREDICTIONS


def write_submission(rows: DataFrame, path: str, case: str = "case_id") -> None:
    """Two text columns with a header, one part file per task."""
    rows.select(F.col(case).cast("string").alias("case_id"), F.col("annotation").cast("string").alias("annotation")).write.mode("overwrite").option("header", True).csv(path)


def append_predictions(rows: DataFrame, path: str) -> None:
    """Predictions added to a folder of CSV files, missing values as blanks."""
    names = [c.split()[0] for c in PREDICTIONS.split(", ")]
    have = set(rows.columns)
    kinds = dict(c.split() for c in PREDICTIONS.split(", "))
    rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in names]).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def label_files(dets: DataFrame, image: str, w, h, with_conf: bool = False, images: DataFrame | None = None) -> DataFrame:
    """Text of each image's label file, best detection first; images without detections have an empty text."""
    line = G.yolo_line(F.col("class_id"), G.box(), w, h, F.col("conf") if with_conf else None)
    lines = dets.groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "row_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return lines if images is None else images.select(image).distinct().join(lines, image, "left").withColumn("text", F.coalesce("text", F.lit("")))


def detections_json(dets: DataFrame, image: str, raw: bool = False) -> DataFrame:
    """One JSON document of detections per image; ``raw`` adds the rows as numbers.

    The document is one value of the format, so an image's detections meet in one
    row.  JSON has no NaN: a conf that is not a number is written as missing.
    """
    conf = F.when(~F.isnan(F.col("conf").cast("double")), F.col("conf")).alias("conf")
    item = F.struct("row_no", F.struct(F.array("x1", "y1", "x2", "y2").alias("xyxy"), conf, "class_id", "class_name").alias("d"))
    items = F.array_sort(F.collect_list(item))
    fields = [F.transform(items, lambda x: x["d"]).alias("detections")]
    if raw:
        fields.append(F.transform(items, lambda x: F.concat(F.transform(x["d"]["xyxy"], lambda v: v.cast("double")), F.array(x["d"]["conf"], x["d"]["class_id"].cast("double")))).alias("raw"))
    return dets.groupBy(image).agg(F.to_json(F.struct(*fields)).alias("json"))


def read_detections_json(rows: DataFrame, image: str, text: str = "json") -> DataFrame:
    """Detections from their JSON, with the names of older files (box_xyxy, cls) or from raw rows."""
    j = rows.select(image, F.from_json(text, "detections array<struct<xyxy:array<double>,box_xyxy:array<double>,conf:double,class_id:int,cls:int,class_name:string>>, raw array<array<double>>").alias("j"))
    items = F.coalesce(F.transform("j.detections", lambda d: F.struct(F.coalesce(d["xyxy"], d["box_xyxy"]).alias("b"), d["conf"].alias("conf"), F.coalesce(d["class_id"], d["cls"]).alias("class_id"), d["class_name"].alias("class_name"))),
                       F.transform("j.raw", lambda r: F.struct(F.slice(r, 1, 4).alias("b"), r[4].alias("conf"), r[5].cast("int").alias("class_id"), F.lit(None).cast("string").alias("class_name"))))
    d = j.select(image, F.posexplode(items).alias("row_no", "d"))
    return d.select(image, "row_no", *[F.get("d.b", F.lit(i)).alias(n) for i, n in enumerate(G.Box._fields)], "d.conf", "d.class_id", "d.class_name")


def write_classes(spark, names: list[str], path: str, val: bool = True) -> None:
    """Class list and data set description of a detector's training folder."""
    spark.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/classes")
    doc = {"train": "images/train", **({"val": "images/val"} if val else {}), "nc": len(names), "names": names}
    spark.createDataFrame([("\n".join(f"{k}: {json.dumps(v)}" for k, v in doc.items()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/data")


def model_report(metrics: DataFrame, model: str, columns: list[str], best_by: str) -> DataFrame:
    """A Markdown table of models, the best first: lines in order."""
    cells = F.concat_ws(" | ", F.col(model), *[F.format_string("%.4f", F.col(c).cast("double")) for c in columns])
    head = metrics.sparkSession.createDataFrame([(0, "| " + " | ".join([model, *columns]) + " |"), (1, "|" + "---|" * (len(columns) + 1))], "n int, line string")
    from pyspark.sql import Window as W

    # one row per model
    rows = metrics.select((F.row_number().over(W.orderBy(F.col(best_by).desc(), model)) + 1).alias("n"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return head.unionByName(rows).orderBy("n")
