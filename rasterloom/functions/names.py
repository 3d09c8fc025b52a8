"""Paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_name(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/\\]*)$", 1)


def path_dir(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)[/\\]", 1)


def path_ext(p: Column) -> Column:
    return F.regexp_extract(path_name(p), r"\.([^.]*)$", 1)


def path_title(p: Column) -> Column:
    return F.regexp_replace(path_name(p), r"\.[^.]*$", "")


def path_full_ext(p: Column) -> Column:
    """All extensions: map.bin of a.map.bin."""
    return F.regexp_extract(path_name(p), r"^[^.]*\.(.*)$", 1)


def with_ext(p: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(p, r"\.[^./\\]*$", ""), F.lit(f".{ext}"))


def fix_separators(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def identifier(s: Column) -> Column:
    """A valid C identifier: _ in place of what cannot stand in one, and of a first character that is no letter."""
    return F.concat(F.regexp_replace(F.coalesce(F.nullif(F.substr(s, F.lit(1), F.lit(1)), F.lit("")), F.lit("_")), "[^A-Za-z]", "_"), F.regexp_replace(F.substr(s, F.lit(2)), "[^A-Za-z0-9_]", "_"))
