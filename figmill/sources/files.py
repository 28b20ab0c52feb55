"""Files as tables: images, masks, annotations, records and packages."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Image extensions listed where none are named.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]
#: Columns of the prediction table of a pair benchmark.
PREDICTIONS = ("pair_id string, label int, pred_is_match int, score double, matched_keypoints int, shared_area_a double, shared_area_b double, is_flipped int, time_ms double, status string, "
               "error_type string, error_msg string, a_path string, b_path string, a_mask_path string, b_mask_path string, iou_a double, iou_b double, dice_a double, dice_b double")


def extensions(names: list[str]) -> list[str]:
    """Lower case, without dots and blanks."""
    return sorted({n.strip().lower().lstrip(".") for n in names if n.strip().lstrip(".")})


def list_files(spark: SparkSession, root: str, exts: list[str] | None = None, recursive: bool = True, content: bool = False) -> DataFrame:
    """Files of a folder by extension in any letter case: ``path, name, stem, ext, length[, content]``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.regexp_replace("path", r"^.*/", "")
    df = df.withColumn("name", name).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).withColumn("stem", F.regexp_replace("name", r"(.)\.[^.]*$", "$1"))
    cols = ["path", "name", "stem", "ext", "length"] + (["content"] if content else [])
    return df.where(F.col("ext").isin(extensions(exts or IMAGE_EXTENSIONS))).select(*cols)


def relative_path(path: Column, root: str) -> Column:
    """Path below a root; the base name where it lies elsewhere."""
    r = root.rstrip("/") + "/"
    p = F.regexp_replace(path, r"^file:/+", "/")
    return F.when(F.startswith(p, F.lit(r)), F.substring(p, F.lit(len(r) + 1), F.length(p))).otherwise(F.regexp_replace(p, r"^.*/", ""))


def pair_examples(files: DataFrame, root: str, strict: bool = True) -> DataFrame:
    """Pairs of a folder tree ``match|no_match/**/{A,B}.png`` with optional masks and ``meta.json``.

    ``files`` has ``path``; with ``strict`` a pair needs both images.
    """
    f = files.select(relative_path(F.col("path"), root).alias("rel"), "path").select(F.regexp_replace("rel", r"/[^/]+$", "").alias("dir"), F.regexp_replace("rel", r"^.*/", "").alias("name"), "path")
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("path")))
    g = f.groupBy("dir").agg(pick("A.png").alias("a_path"), pick("B.png").alias("b_path"), pick("A_mask.png").alias("a_mask_path"), pick("B_mask.png").alias("b_mask_path"), pick("meta.json").alias("meta_path"))
    g = g.where("a_path is not null").where("b_path is not null" if strict else "true")
    subset = F.regexp_extract("dir", r"(?:^|/)(match|no_match)(?:/|$)", 1)
    return g.where(subset != "").select(F.replace(F.regexp_replace("dir", r"^.*?(?=(?:match|no_match)(?:/|$))", ""), F.lit("/"), F.lit("__")).alias("pair_id"), (subset == "match").cast("int").alias("label"), "a_path", "b_path", "a_mask_path", "b_mask_path", "meta_path")


def seeded_order(rows: DataFrame, ident: str, seed: int, limit: int | None = None) -> DataFrame:
    """Rows in a seeded hash order; with ``limit`` the first of it (a sampling operator)."""
    out = rows.orderBy(F.xxhash64(F.lit(seed), ident), ident)
    return out if limit is None else out.limit(limit)


def read_predictions(spark: SparkSession, path: str, retry_errors: bool = False) -> DataFrame:
    """Finished pairs of a benchmark; blanks are missing; failed ones left out where they are to run again."""
    df = spark.read.schema(PREDICTIONS).option("header", True).option("nullValue", "").csv(path)
    return df.where(~F.col("status").eqNullSafe("error")) if retry_errors else df


def read_panels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("figure_id string, panel_id string, panel_label string, x1 int, y1 int, x2 int, y2 int").option("header", True).csv(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Panels of polygon annotation files: ``file, panel_id, label, x1..y2``, clamped, empty ones dropped, numbered by place."""
    schema = "imageHeight int, imageWidth int, shapes array<struct<label:string,points:array<array<double>>,shape_type:string>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "imageHeight", "imageWidth", F.explode("shapes").alias("s"))
    x, y = F.transform("s.points", lambda p: p[0]), F.transform("s.points", lambda p: p[1])
    b = df.where(F.size("s.points") > 0).select("file", F.col("s.label").alias("label"), F.greatest(F.floor(F.array_min(x)), F.lit(0)).cast("int").alias("x1"), F.greatest(F.floor(F.array_min(y)), F.lit(0)).cast("int").alias("y1"),
                                                  F.least(F.ceil(F.array_max(x)), F.col("imageWidth")).cast("int").alias("x2"), F.least(F.ceil(F.array_max(y)), F.col("imageHeight")).cast("int").alias("y2"))
    w = W.partitionBy("file").orderBy("y1", "x1", "x2", "y2", "label")
    return b.where("x2 > x1 and y2 > y1").withColumn("panel_id", F.format_string("p%03d", F.row_number().over(w)))


def read_figure_boxes(lines: DataFrame, ident: str, text: str) -> DataFrame:
    """Boxes of figure annotations in JSON: only keys of digits are boxes; corners are swapped where inverted."""
    a = lines.select(ident, F.from_json(text, "figure_annotations map<string,string>").alias("j")).select(ident, F.explode("j.figure_annotations").alias("key", "value")).where(F.col("key").rlike("^[0-9]+$"))
    v = F.from_json("value", "class string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    a = a.select(ident, F.col("key").cast("int").alias("box_id"), v.alias("v")).where("v.bbox is not null")
    return a.select(ident, "box_id", F.col("v.class").alias("label"), F.least("v.bbox.x0", "v.bbox.x1").alias("x1"), F.least("v.bbox.y0", "v.bbox.y1").alias("y1"), F.greatest("v.bbox.x0", "v.bbox.x1").alias("x2"), F.greatest("v.bbox.y0", "v.bbox.y1").alias("y2"))


def class_names(payload: str) -> dict[int, str]:
    """Class map from its accepted shapes: {id: name}, {name: id}, [names], or any of these under ``names``."""
    import json

    data = json.loads(payload)
    if isinstance(data, dict) and "names" in data:
        data = data["names"]
    if isinstance(data, list):
        return {i: str(n) for i, n in enumerate(data)}
    if not isinstance(data, dict) or not data:
        raise ValueError("no class names found")
    if all(str(k).lstrip("-").isdigit() for k in data):
        return {int(k): str(v) for k, v in data.items()}
    return {int(v): str(k) for k, v in data.items()}


def jats_figures(xml: DataFrame, ident: str, text: str) -> DataFrame:
    """Figures of article XML: one row per graphic with its caption (namespaces and DOCTYPE are read over)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = ET.fromstring(t)
                except (ET.ParseError, TypeError):
                    continue
                local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
                for fig in (e for e in root.iter() if local(e) == "fig"):
                    cap = next((" ".join("".join(c.itertext()).split()) for c in fig.iter() if local(c) == "caption"), None)
                    for g in (e for e in fig.iter() if local(e) in ("graphic", "inline-graphic")):
                        href = next((v for k, v in g.attrib.items() if k.rpartition("}")[2] == "href"), None)
                        out.append((i, fig.get("id"), href, cap))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.column(0).type)] + [pa.array([o[k] for o in out], pa.string()) for k in (1, 2, 3)], names=["ident", "figure_id", "href", "caption"])

    kind = xml.schema[ident].dataType.simpleString()
    return xml.select(F.col(ident).alias("ident"), text).mapInArrow(run, f"ident {kind}, figure_id string, href string, caption string").withColumnRenamed("ident", ident)


def open_access_record(xml: Column) -> Column:
    """Error code, licence and package link of an open-access service answer."""
    safe = F.when(xml.rlike(r"(?s)^\s*<.*>\s*$"), xml)
    return F.struct(F.xpath_string(safe, F.lit("//error/@code")).alias("error"), F.xpath_string(safe, F.lit("//record/@license")).alias("license"), F.xpath_string(safe, F.lit("//link[@format='tgz']/@href")).alias("href"))


def archive_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Members of gzipped tar archives: ``path, member, n_bytes``; an unreadable archive gives one row with an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with tarfile.open(fileobj=io.BytesIO(c), mode="r:*") as tar:
                        out += [(p, m.name, m.size, None) for m in tar if m.isfile()]
                except (tarfile.TarError, OSError, EOFError, TypeError) as e:
                    out.append((p, None, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string())], names=["path", "member", "n_bytes", "error"])

    return files.select(path, content).mapInArrow(run, "path string, member string, n_bytes bigint, error string")


def wanted_members(members: DataFrame, wanted: DataFrame, href: str = "href") -> DataFrame:
    """Image members whose full or base name is wanted and that are no thumbnails."""
    from figmill.functions.text import is_thumbnail

    base = F.regexp_replace("member", r"^.*/", "")
    m = members.where(F.lower("member").rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$") & ~is_thumbnail(F.col("member"))).withColumn("k", F.explode(F.array_distinct(F.array(F.col("member"), base, F.regexp_replace(base, r"(.)\.[^.]*$", "$1")))))
    return m.join(wanted.select(F.col(href).alias("k")).distinct(), "k", "left_semi").drop("k").distinct()


# -- arrays in files --------------------------------------------------------------

def channel_axis(shape: tuple[int, ...], expected: tuple[int, int] | None = None) -> int | None:
    """Axis of a 3-d mask that counts instances: the one besides the expected height and width, else the smallest."""
    if len(shape) != 3:
        return None
    if expected:
        for axis in (0, 2, 1):
            if tuple(s for i, s in enumerate(shape) if i != axis) == tuple(expected):
                return axis
    return int(np.argmin(shape))


def read_masks(content: bytes, expected: tuple[int, int] | None = None) -> list[np.ndarray]:
    """Boolean masks of an npy or npz file (key ``mask``, else the first); one per instance."""
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(a, np.lib.npyio.NpzFile):
        a = a["mask"] if "mask" in a.files else a[a.files[0]]
    a = a > 0.5 if a.dtype.kind == "f" else a != 0
    if a.ndim == 2:
        return [a]
    axis = channel_axis(a.shape, expected)
    if axis is None:
        raise ValueError(f"no instance axis in {a.shape}")
    return list(np.moveaxis(a, axis, 0))


def mask_runs(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Mask files as runs: ``path, mask_no, height, width, runs`` (column-major); empty masks are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, c in zip(pdf[path], pdf[content]):
                for n, m in enumerate(read_masks(bytes(c)), 1):
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], m.T.ravel().view(np.int8), [0]))))
                    if len(edge):
                        out.append((p, n, m.shape[0], m.shape[1], [{"start": int(a), "len": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]))
            if out:
                yield pd.DataFrame(out, columns=["path", "mask_no", "height", "width", "runs"])

    return files.select(path, content).mapInPandas(run, "path string, mask_no int, height int, width int, runs array<struct<start:bigint,len:bigint>>")


def read_manifest(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Positives of an augmentation manifest in JSON lines; with ``existing`` (a column ``path``) both files must be there."""
    schema = "kind string, source_file string, orig_file string, variant_file string, variant_id int, seed bigint, transforms array<struct<name:string,params:map<string,string>>>, tags array<string>"
    m = spark.read.schema(schema).json(path).where("kind = 'aug_positive' and orig_file is not null and variant_file is not null")
    if existing is not None:
        e = existing.select("path").distinct()
        for c in ("orig_file", "variant_file"):
            m = m.join(e.withColumnRenamed("path", c), c, "left_semi")
    return m.dropDuplicates(["variant_file"])


def package_xml(members: DataFrame, package: str = "path") -> DataFrame:
    """The article file of each package: the last .nxml, else the first XML; an error text where there is none."""
    m = members.where(F.lower("member").rlike(r"\.n?xml$")).withColumn("nxml", F.lower("member").endswith(".nxml"))
    best = m.groupBy(package).agg(F.max(F.when(F.col("nxml"), F.col("member"))).alias("a"), F.min("member").alias("b"))
    return members.select(package).distinct().join(best, package, "left").select(package, F.coalesce("a", "b").alias("xml"), F.when(F.coalesce("a", "b").isNull(), "no XML in package").alias("error"))


def article_licences(xml: DataFrame, ident: str, text: str) -> DataFrame:
    """First licence of article XML: ``type, url, text``, else the text of its permissions; unreadable XML gives NULLs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        local = lambda s: s.rpartition("}")[2] if isinstance(s, str) else ""
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = ET.fromstring(t)
                except (ET.ParseError, TypeError):
                    out.append((i, None, None, None))
                    continue
                lic = next((e for e in root.iter() if local(e.tag) == "license"), None)
                e = lic if lic is not None else next((e for e in root.iter() if local(e.tag) == "permissions"), None)
                words = " ".join("".join(e.itertext()).split()) if e is not None else None
                attr = {local(k): v for k, v in (lic.attrib if lic is not None else {}).items()}
                url = attr.get("href") or (next((v for x in lic.iter() for k, v in x.attrib.items() if local(k) == "href"), None) if lic is not None else None)
                out.append((i, attr.get("license-type"), url, words or None))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.column(0).type)] + [pa.array([o[k] for o in out], pa.string()) for k in (1, 2, 3)], names=["ident", "license_type", "license_url", "license_text"])

    kind = xml.schema[ident].dataType.simpleString()
    return xml.select(F.col(ident).alias("ident"), text).mapInArrow(run, f"ident {kind}, license_type string, license_url string, license_text string").withColumnRenamed("ident", ident)


def images_beside(annotations: DataFrame, images: DataFrame, exclude: list[str]) -> DataFrame:
    """Images in the folder of each annotation, without names that hold an excluded text: ``annotation, image``."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    i = images.select(F.col("path").alias("image"), folder.alias("dir"))
    for x in exclude:
        i = i.where(~F.contains(F.regexp_replace("image", r"^.*/", ""), F.lit(x)))
    return annotations.select(F.col("path").alias("annotation"), folder.alias("dir")).join(i, "dir").select("annotation", "image")


def file_statistics(files: DataFrame, by: str = "ext") -> DataFrame:
    """Files, bytes and mean size per extension (or another column)."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.avg("length").alias("mean_bytes"))


def value_counts(arrays: DataFrame, ident: str, column: str) -> DataFrame:
    """How often each value stands in an array column, and its share."""
    n = arrays.select(ident, F.explode(column).alias("value")).groupBy(ident, "value").agg(F.count(F.lit(1)).alias("n"))
    return n.join(arrays.select(ident, F.size(column).alias("size")), ident).select(ident, "value", "n", (F.col("n") / F.col("size")).alias("share"))
