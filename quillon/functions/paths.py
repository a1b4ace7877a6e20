"""Dotted-path access into structs, maps and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def nested(df: DataFrame, path: str) -> Column:
    """`a.b.c` out of structs, maps or JSON text columns; null where a step is missing."""
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None)
    value, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for at, part in enumerate(rest):
        if isinstance(kind, T.StructType):
            if part not in kind.fieldNames():
                return F.lit(None)
            value, kind = value.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(part)), kind.valueType
        elif isinstance(kind, T.StringType):
            return F.get_json_object(value, "$." + ".".join(rest[at:]))
        elif isinstance(kind, T.VariantType):
            return F.try_variant_get(value, "$." + ".".join(rest[at:]), "string")
        else:
            return F.lit(None)
    return value


def numeric(df: DataFrame, path: str) -> Column:
    """The number at a path, as double: booleans count as 1 and 0, anything else is null.

    Inside JSON text the quoted `"5"` is text, not a number, so the JSON type decides.
    """
    head, *rest = path.split(".")
    kind = df.schema[head].dataType if head in df.columns else None
    if rest and isinstance(kind, T.StringType):
        json_path = "$." + ".".join(rest)
        element = F.try_variant_get(F.try_parse_json(F.col(f"`{head}`")), json_path, "variant")
        json_type = F.schema_of_variant(element)
        is_number = json_type.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        text = F.get_json_object(F.col(f"`{head}`"), json_path)
        return F.when(is_number, text.try_cast("double")).when(
            json_type == "BOOLEAN", (text == "true").cast("double")
        )
    value = nested(df, path)
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    return F.lit(None).cast("double")


def matches(df: DataFrame, filters: dict[str, object]) -> Column:
    """True when every dotted path equals its value, or is one of its list of values."""
    kept = F.lit(True)
    for path, wanted in filters.items():
        value = nested(df, path)
        if isinstance(wanted, (list, tuple, set)):
            test = value.isin(list(wanted)) if wanted else F.lit(False)
        else:
            test = value == F.lit(wanted)
        kept = kept & F.coalesce(test, F.lit(False))
    return kept
