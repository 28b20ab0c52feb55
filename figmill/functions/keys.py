"""Comparable forms of loosely written identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def article_digits(pmcid: Column) -> Column:
    """Digits of an article id; NULL where it has none."""
    digits = F.regexp_replace(pmcid, "[^0-9]", "")
    return F.when(digits != "", digits)


def plain_pmcid(pmcid: Column) -> Column:
    return F.concat(F.lit("PMC"), article_digits(pmcid))


def instant(text: Column) -> Column:
    """Point in time of an ISO-like text; no zone means UTC, unreadable is NULL."""
    t = F.trim(text)
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = t.rlike(r"(?i)(z|[+-]\d{2}:\d{2})$") & t.rlike(r"[T ]\d")
    return F.when(zoned, t).otherwise(F.concat(t, F.when(t.rlike(r"[T ]\d"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))).try_cast("timestamp")


def utc_instant(df: DataFrame, name: str) -> Column:
    """A timestamp column as a point in time; one without a zone is read as UTC."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    return F.concat(F.col(name).cast("string"), F.lit("Z")).try_cast("timestamp")


def status_key(status: Column) -> Column:
    return F.upper(F.trim(status))


def hash_key(sha256: Column) -> Column:
    """The 64 hex digits in lower case; NULL for a failed (zeros only) or unreadable hash."""
    h = F.regexp_extract(F.lower(sha256), r"(?:^|[^0-9a-f])([0-9a-f]{64})\s*$", 1)
    return F.when((h != "") & ~h.rlike("^0+$"), h)


def path_key(path: Column, pmcid: Column) -> Column:
    """A path inside the article's package; NULL where it is null or blank.

    Letter case, separators, percent escapes, blanks around, a leading dot and
    a leading folder named like the article do not count.
    """
    p = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    p = F.lower(F.trim(F.regexp_replace(p, r"[\t\r\n ]", " ")))
    p = F.regexp_replace(p, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(\.?/)+", "")
    p = F.regexp_replace(p, r"/\./", "/")
    folder = F.regexp_extract(p, r"^(?:pmc)?\s*([0-9]+)/", 1)
    p = F.when((folder != "") & (folder == article_digits(pmcid)), F.regexp_replace(p, r"^[^/]*/", "")).otherwise(p)
    return F.when(F.trim(p) != "", F.trim(p))


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def without_extension(path: Column) -> Column:
    """A path without the extension of its base name (a name that only starts with a dot keeps it)."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def has_extension(path: Column) -> Column:
    return path.rlike(r"[^/]\.[^./]+$")


def panel_stem(panel: Column) -> Column:
    """A panel uid without blanks around it and without its ``::cls=`` ending."""
    return F.regexp_replace(F.trim(panel), r"::cls=[^:]*$", "")
