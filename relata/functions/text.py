"""Formatting, identifiers and digests, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digits(c: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros; scientific outside 1e-4 to 1e6."""
    exponent = F.floor(F.log10(F.abs(c)))
    places = (F.lit(5) - exponent).cast("int")
    scaled = F.round(c * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", scaled), r"0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", c / F.pow(F.lit(10.0), exponent)), r"0+$", ""), r"\.$", "")
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(c == 0, F.lit("0")).when((exponent >= -4) & (exponent < 6), digits).otherwise(F.concat(mantissa, power))


def pair_id(capture: Column, index: Column) -> Column:
    return F.format_string("%s-P%02d", capture, index)


def archive_capture_id(name: Column, pattern: str = r"(\d+)\.tar$") -> Column:
    """The capture's id in an archive's name, null if it has none."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def display_path(path: Column, root: str) -> Column:
    """A path as it is shown: below the root by its place there, the root itself as a dot, others whole."""
    base = root.rstrip("/")
    return F.when(path == base, ".").when(F.startswith(path, F.lit(base + "/")), F.substring(path, F.lit(len(base) + 2), F.length(path))).otherwise(path)


def salted_key(salt: str, identifier: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), identifier.cast("string")), 256)


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def unordered_pair(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def canonical_json(pairs: Column) -> Column:
    """A map as JSON with its keys in order, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))
