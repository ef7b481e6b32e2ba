"""Typed reads from VARIANT columns. Wrong types give NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return f"$['{key}']" if not key.replace("_", "").isalnum() else f"$.{key}"


def field(value: Column, key: str) -> Column:
    """Member of an object as VARIANT; NULL when absent."""
    return F.try_variant_get(value, _path(key), "variant")


def members(value: Column, keys: Sequence[str]) -> Column:
    """struct of the named members as VARIANTs, read in one pass; NULL when not an object."""
    kind = ", ".join(f"`{k}`: variant" for k in keys)
    return F.try_variant_get(value, "$", f"struct<{kind}>")


def shaped(value: Column, kind: str) -> Column:
    """A value read as the given type in one pass; parts of another type are NULL."""
    return F.try_variant_get(value, "$", kind)


def item(value: Column, index: int) -> Column:
    """Element of an array as VARIANT; NULL when absent."""
    return F.try_variant_get(value, f"$[{index}]", "variant")


def as_object(value: Column) -> Column:
    """map<string,variant> of an object, else NULL."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    """array<variant> of an array, else NULL."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_absent(value: Column) -> Column:
    """True for a missing member and for JSON null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def scalar_kind(value: Column) -> Column:
    """Type name of a small value, e.g. STRING, BIGINT, BOOLEAN, ARRAY<...>."""
    return F.schema_of_variant(value)


def only_string(value: Column) -> Column:
    """The text of a JSON string; NULL for every other type."""
    return F.when(scalar_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def dump(value: Column) -> Column:
    """JSON text with sorted object keys."""
    return F.to_json(value)


def text_or_dump(value: Column) -> Column:
    """A string as it is, any other non-null value as JSON text."""
    return F.when(~is_absent(value), F.coalesce(only_string(value), dump(value)))


def plain_text(value: Column) -> Column:
    """Like text_or_dump, except that booleans become 1 and 0, as a text column stores them."""
    return F.when(
        scalar_kind(value) == "BOOLEAN",
        F.try_variant_get(value, "$", "boolean").cast("int").cast("string"),
    ).otherwise(text_or_dump(value))


def whole_number(value: Column) -> Column:
    """BIGINT from a whole number, a numeric text or a boolean; NULL otherwise."""
    kind = scalar_kind(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind.isin("BIGINT", "BOOLEAN"), F.try_variant_get(value, "$", "bigint"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string").try_cast("bigint"))
        .when(number == F.floor(number), F.try_variant_get(value, "$", "bigint"))
    )


def only_integer(value: Column) -> Column:
    """BIGINT only when the JSON value is an integer (a boolean counts as one)."""
    return F.when(
        scalar_kind(value).isin("BIGINT", "BOOLEAN"), F.try_variant_get(value, "$", "bigint")
    )


def describe(value: Column) -> Column:
    """Short description for anomaly details: type, and size or keys, never values."""
    from askledger.functions.text import capped_list

    members = as_object(value)
    items = as_array(value)
    return (
        F.when(is_absent(value), "absent")
        .when(
            members.isNotNull(),
            F.concat(F.lit("object{"), capped_list(F.sort_array(F.map_keys(members))), F.lit("}")),
        )
        .when(items.isNotNull(), F.format_string("list[%d]", F.size(items)))
        .when(
            scalar_kind(value) == "STRING",
            F.format_string("text[%d]", F.length(F.try_variant_get(value, "$", "string"))),
        )
        .otherwise(F.lower(scalar_kind(value)))
    )
