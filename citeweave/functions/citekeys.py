"""Citation keys and bibliographic fields from file names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import text as T

# Shapes of file names, tried in this order.
AUTHOR_YEAR = r"^([A-Za-z][\w'-]+)\s+(?:et al\.?\s*[-–]\s*)?(\d{4})"
AUTHOR_COMMA_YEAR = r"^([A-Za-z][\w'-]+),\s*[A-Z].*?[-–]\s*(\d{4})"
FULL_NAME = r"^([A-Za-z][\w'-]+)(?:\s+et\s+al\.?)?\s*[-–]\s*(\d{4})\s*[-–]\s*(.+)"


def _key(stem: Column, pattern: str) -> Column:
    name = F.replace(F.lower(F.regexp_extract(stem, pattern, 1)), F.lit("-"), F.lit(""))
    return F.concat(F.lit("@"), name, F.regexp_extract(stem, pattern, 2))


def from_filename(filename: Column) -> Column:
    """Key by the first file-name shape that fits."""
    stem = T.strip(F.replace(F.lower(filename), F.lit(".pdf"), F.lit("")))
    parts = F.split(stem, r"[_\s-]+")
    first = F.element_at(parts, 1)
    year = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^\d{4}$")), F.lit(1))
    return (
        F.when(stem.rlike(AUTHOR_YEAR), _key(stem, AUTHOR_YEAR))
        .when(stem.rlike(AUTHOR_COMMA_YEAR), _key(stem, AUTHOR_COMMA_YEAR))
        .when(stem.rlike(r"^\d+"), F.concat(F.lit("@ref_"), F.substring(F.sha2(stem, 256), 1, 8)))
        .otherwise(F.concat(F.lit("@"), first, F.coalesce(year, F.lit(""))))
    )


def metadata(filename: Column) -> Column:
    """Struct ``(surname, date, title)`` of a file name; only the title when the shape is unknown."""
    stem = T.strip(F.regexp_replace(filename, r"(?i)\.pdf$", ""))
    fits = stem.rlike(FULL_NAME)
    title = F.regexp_replace(T.strip(F.regexp_extract(stem, FULL_NAME, 3)), r"\.+$", "")
    return F.struct(
        F.when(fits, F.regexp_extract(stem, FULL_NAME, 1)).otherwise("").alias("surname"),
        F.when(fits, F.regexp_extract(stem, FULL_NAME, 2)).otherwise("").alias("date"),
        F.substring(F.when(fits, title).otherwise(stem), 1, 500).alias("title"))


def from_identifiers(doi: Column, pmcid: Column, title: Column) -> Column:
    """Key by DOI digest, else by archive id, else by a slug of the title."""
    blank = F.lit("")
    slug = F.substring(F.regexp_replace(F.lower(T.strip(title)), "[^a-z0-9]+", "_"), 1, 30)
    return (
        F.when(F.coalesce(doi, blank) != "", F.concat(F.lit("@ref_"), F.substring(F.sha2(F.lower(doi), 256), 1, 8)))
        .when(F.coalesce(pmcid, blank) != "", F.concat(F.lit("@ref_"), F.lower(pmcid)))
        .when(F.coalesce(title, blank) != "", F.concat(F.lit("@"), slug))
        .otherwise("@ref_unknown")
    )


def resolve(library: Column, filename: Column, content_hash: Column) -> Column:
    """Library key, else key from the file name, else key from the content hash."""
    return F.coalesce(
        F.nullif(library, F.lit("")), F.nullif(from_filename(filename), F.lit("@")),
        F.concat(F.lit("@ref_"), F.substring(content_hash, 1, 8)))
