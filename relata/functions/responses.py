"""Numbers out of free-text model responses, and their errors, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def without_fence(raw: Column) -> Column:
    """The text without white space at its ends and, if it starts with one, without its code fence."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^(?U)\s+", ""), r"(?U)\s+$", "")
    opened = F.regexp_replace(text, r"^(?i)```(?:json)?\s*", "")
    return F.when(F.startswith(text, F.lit(FENCE)), F.regexp_replace(opened, r"\s*```$", "")).otherwise(text)


def _distance(document: Column, key: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    return F.when((number > 0) & (number < float("inf")), number)


def parse_distance(raw: Column, key: str = "distance_m") -> Column:
    """The positive finite number under ``key``: of the whole text if it is one JSON object, else of the first shortest ``{...}`` in it, else null.

    Numbers written as text, booleans, NaN and values out of range are not
    numbers here.  Of an object with the key twice nothing is taken.
    """
    text = without_fence(raw)
    whole = F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text)
    first = F.nullif(F.regexp_extract(text, r"(?s)\{.*?\}", 0), F.lit(""))
    return F.coalesce(_distance(whole, key), _distance(first, key))


def absolute_error(predicted: Column, truth: Column) -> Column:
    return F.abs(predicted - truth)


def relative_error(predicted: Column, truth: Column) -> Column:
    return F.abs(predicted - truth) / truth


def ratio(predicted: Column, truth: Column) -> Column:
    return predicted / truth


def log_error(predicted: Column, truth: Column) -> Column:
    return F.when((predicted > 0) & (truth > 0), F.ln(predicted / truth))
