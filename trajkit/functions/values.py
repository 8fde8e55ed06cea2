"""Tests on VARIANT values. A missing value is SQL NULL, a JSON null a VARIANT that holds null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: JSON texts of what counts as false: null, false, zero, and empty strings, lists and objects.
_FALSY = r'^(null|false|""|\[\]|\{\}|-?0(\.0+)?([eE][+-]?\d+)?)$'
#: Kinds that compare with a number.
_NUMBER_OR_BOOLEAN = "^(BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it; inside lambdas nothing else shares it."""
    return F.transform(F.array(value), body)[0]


def parsed(line: Column) -> Column:
    """The VARIANT of a JSON text, NULL for anything else.

    The parser stops after the first value; in brackets, what follows it is an error or a second element.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("\n]")))
    return let(items(listed), lambda x: F.when(F.size(x) == 1, F.try_element_at(x, F.lit(1))))


def get(value: Column, path: str, kind: str = "variant") -> Column:
    """What stands at path below value; NULL if nothing does or if it isn't of that kind."""
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    """The string, NULL for every other kind."""
    return F.when(kind(value) == "STRING", get(value, "", "string"))


def items(value: Column) -> Column:
    """The list's elements; empty for what is no list."""
    return F.coalesce(get(value, "", "array<variant>"), F.array().cast("array<variant>"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("OBJECT")), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("ARRAY")), F.lit(False))


def truthy(value: Column) -> Column:
    """False for missing, null, false, zero, and empty strings, lists and objects."""
    return F.coalesce(~F.rlike(F.to_json(value), F.lit(_FALSY)), F.lit(False))


def is_true(value: Column) -> Column:
    """JSON true and nothing else."""
    return F.coalesce((kind(value) == "BOOLEAN") & get(value, "", "boolean"), F.lit(False))


def equals_one(value: Column) -> Column:
    """1, 1.0 or true; the string "1" is none of these."""
    return F.coalesce(F.rlike(kind(value), F.lit(_NUMBER_OR_BOOLEAN)) & (get(value, "", "double") == 1.0), F.lit(False))


def as_text(value: Column) -> Column:
    """The value as it is put into an action: strings as they are, None, True and False for null and booleans."""
    def by_kind(x: Column) -> Column:
        return (
            F.when(kind(x) == "STRING", get(x, "", "string"))
            .when(kind(x) == "VOID", "None")
            .when(kind(x) == "BOOLEAN", F.initcap(get(x, "", "string")))
            .when(F.rlike(kind(x), F.lit("^(DECIMAL|DOUBLE|FLOAT)")), get(x, "", "double").cast("string"))
            .when(F.rlike(kind(x), F.lit("^(ARRAY|OBJECT)")), F.to_json(x))
            .otherwise(get(x, "", "string"))
        )

    return let(value, by_kind)


def json_text(value: Column) -> Column:
    """A string column as a JSON string literal."""
    return F.to_json(value.cast("variant"))
