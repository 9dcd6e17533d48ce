"""Values of JSON rows as they were written: VARIANT columns beside the text, in which a boolean is no number and a null is not a missing field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")
KINDS = {"BOOLEAN": "boolean", "STRING": "string", "VOID": "null", "BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number", "OBJECT": "object", "ARRAY": "array"}


def with_variant(lines: DataFrame, line: str = "line", name: str = "value") -> DataFrame:
    """Adds the line as a VARIANT, null where it is no JSON; the line itself stays as it was written."""
    return lines.withColumn(name, F.try_parse_json(line))


def get(value: Column, field: str) -> Column:
    """A field of a VARIANT, by its path below the root; null only if it is missing."""
    return F.try_variant_get(value, f"$.{field}" if field else "$", "variant")


def kind(value: Column, field: str = "") -> Column:
    """missing, null, boolean, number, string, object or array."""
    found = get(value, field)
    head = F.regexp_extract(F.schema_of_variant(found), "^[A-Z]+", 0)
    named = F.coalesce(*(F.when(head == k, n) for k, n in KINDS.items()), F.lit("other"))
    return F.when(found.isNull(), "missing").otherwise(named)


def is_object(value: Column) -> Column:
    return kind(value) == "object"


def finite_number(value: Column, field: str = "", booleans: bool = False) -> Column:
    """The number as a double, null for anything else; with ``booleans`` true and false pass as 1 and 0, as in the instance rules."""
    k = kind(value, field)
    number = F.when(k == "number", F.try_variant_get(value, f"$.{field}" if field else "$", "double"))
    finite = F.when(~F.isnan(number) & (F.abs(number) < INFINITY), number)
    return F.when(k == "boolean", F.try_variant_get(value, f"$.{field}" if field else "$", "boolean").cast("double")).otherwise(finite) if booleans else finite


def finite_float(value: Column, field: str = "") -> Column:
    """What converts to a finite double: numbers, booleans and texts that are numbers; null else."""
    text = F.when(kind(value, field) == "string", F.trim(F.try_variant_get(value, f"$.{field}" if field else "$", "string")).try_cast("double"))
    return F.coalesce(finite_number(value, field, booleans=True), F.when(~F.isnan(text) & (F.abs(text) < INFINITY), text))


def finite_int(value: Column, field: str = "") -> Column:
    """Whole numbers, however written, and texts of digits; booleans are none.  Null else."""
    number = finite_number(value, field)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), F.try_variant_get(value, f"$.{field}" if field else "$", "double").cast("long"))
    exact = F.try_variant_get(value, f"$.{field}" if field else "$", "bigint")  # beyond 2^53 the double has lost digits
    text = F.when(kind(value, field) == "string", F.try_variant_get(value, f"$.{field}" if field else "$", "string"))
    digits = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))
    return F.coalesce(F.when(whole.isNotNull(), F.coalesce(exact, whole)), digits)


def category(value: Column, field: str = "category") -> Column:
    """Lower case without white space at its ends; a missing category is empty, a null written out 'none', a boolean its name."""
    k = kind(value, field)
    text = F.lower(F.try_variant_get(value, f"$.{field}", "string"))
    clean = F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+", ""), r"(?U)\s+$", "")
    return F.when(k == "missing", "").when(k == "null", "none").otherwise(clean)
