"""Names, slugs, paths and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def panel_uid(figure: Column, panel: Column, det: Column, cls: Column) -> Column:
    """Full panel name; a missing panel number falls back to the detection's index."""
    return F.concat(figure, F.lit("::panel="), F.coalesce(panel, det).cast("string"), F.lit("::det="), det.cast("string"), F.lit("::cls="), cls.cast("string"))


def strip_class(uid: Column) -> Column:
    """A panel name without its last class part."""
    return F.regexp_replace(uid, r"::cls=(?:(?!::cls=).)*$", "")


def slug(s: Column, most: int = 180) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit(most))


def hyphen_slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def name_key(s: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(s), r"[^a-z0-9]", "")


def folder_name(s: Column) -> Column:
    """A class name as a folder: separators become single underscores, other signs go; ``unknown`` if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(s)), r"[ \-_.]+", "_")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9_]", ""), r"_+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "unknown").otherwise(t)


def panel_group(class_name: Column, mode: str = "broad") -> Column:
    """Which panels may be compared: all, those of one class, or of one broad kind."""
    if mode == "none":
        return F.lit("all")
    if mode == "class":
        return F.when(F.coalesce(class_name, F.lit("")) == "", "unknown").otherwise(class_name)
    s = F.lower(F.coalesce(class_name, F.lit("")))
    return F.when(s.contains("blot"), "blot").when(s.contains("micro"), "microscopy").otherwise("other")


def short_hash(path: Column) -> Column:
    return F.left(F.sha1(path), F.lit(8))


def is_thumbnail(name: Column) -> Column:
    return F.lower(name).rlike(r"thumb|_t\.jpg|_t\.png")


def https(url: Column) -> Column:
    return F.regexp_replace(url, r"^ftp://", "https://")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(.)\.[^.]*$", "$1")


def transform_name(s: Column) -> Column:
    """Text before the first bracket, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(s, "(", 1)))


def first_bin(x: Column, bins: list[tuple[str, float, float]]) -> Column:
    """The first half-open bin that holds x, else ``other``."""
    out = F
    for name, lo, hi in bins:
        out = out.when((x >= lo) & (x < hi), name)
    return out.otherwise("other")


def truncated(x: Column, decimals: int) -> Column:
    """A number cut, not rounded, to decimals."""
    return F.format_string(f"%.{decimals}f", F.floor(x * 10**decimals) / 10**decimals)


def human_bytes(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    n = n.cast("double")
    out = F
    for i, u in enumerate(units[:-1]):
        out = out.when(n < 1024.0 ** (i + 1), F.format_string(f"%.2f {u}", n / 1024.0**i))
    return out.otherwise(F.format_string(f"%.2f {units[-1]}", n / 1024.0 ** (len(units) - 1)))


def batch_folder(seq: Column, size: int) -> Column:
    """Numbered folder of the batch a sequence number falls into."""
    return F.format_string("batch_%05d", F.floor((F.greatest(seq, F.lit(1)) - 1) / size).cast("int"))


def natural_key(s: Column) -> Column:
    """Sort key in which runs of digits compare as numbers (up to 20 digits)."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def period_of(path: Column) -> Column:
    """First and last day named in a path as YYYY-MM-DD dates, as a struct."""
    days = F.regexp_extract_all(path, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    return F.struct(F.try_to_date(F.get(days, F.lit(0))).alias("first"), F.try_to_date(F.get(days, F.size(days) - 1)).alias("last"))


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def digits_for(count: Column, least: int = 1) -> Column:
    """Digits that number so many things from 0."""
    return F.greatest(F.lit(least), F.when(count <= 1, F.lit(least)).otherwise(F.length((count - 1).cast("string"))))


def output_name(path: Column, suffix: str, layout: str, index: Column | None = None, batch: int = 1000) -> Column:
    """Relative output path: folders kept, names flattened, or numbered folders of a batch."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    if layout == "preserve":
        return F.concat(bare, F.lit(suffix))
    if layout == "flat":
        return F.concat(F.replace(bare, F.lit("/"), F.lit("__")), F.lit(suffix))
    if layout == "batch":
        return F.concat(F.format_string("batch_%05d/", F.floor(index / batch).cast("int")), F.regexp_replace(bare, r"^.*/", ""), F.lit(suffix))
    raise ValueError(f"unknown layout {layout!r}")


def cadence(path: Column, known: dict[str, str], other: str = "Custom range") -> Column:
    """What the nearest part of a path that is listed stands for."""
    parts = F.reverse(F.split(F.lower(path), "/"))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    hits = F.filter(F.transform(parts, lambda p: F.try_element_at(table, p)), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(other))


def canonical_hash(*columns: Column) -> Column:
    """SHA-1 of the columns as one JSON document."""
    return F.sha1(F.to_json(F.struct(*columns)))


def pairs_in(members: Column) -> Column:
    """All pairs a < b of a short array's distinct members (an operation's panels), as an array of structs."""
    m = F.array_sort(F.array_distinct(members))
    return F.flatten(F.transform(m, lambda a: F.transform(F.filter(m, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
