"""Lookups of rows by what their metadata holds."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Wanted = dict | list | str | int | float | bool | None


def _path(key: str) -> str:
    quote = '"' if "'" in key else "'"
    if quote in key:
        raise ValueError(f"a key with both quotes can't be looked up: {key}")
    return f"$[{quote}{key}{quote}]"


def holds(value: Column, wanted: Wanted) -> Column:
    """Whether a variant contains what is wanted: all keys of an object, each element of an array in some place, equal values of one kind."""
    kind = F.schema_of_variant(value)
    same = lambda t: F.try_variant_get(value, "$", t) == F.lit(wanted)
    if isinstance(wanted, dict):
        parts = [kind.startswith("OBJECT"), *(holds(F.try_variant_get(value, _path(k), "variant"), w) for k, w in wanted.items())]
    elif isinstance(wanted, list):
        some = lambda w: F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: holds(x, w))
        parts = [kind.startswith("ARRAY"), *(some(w) for w in wanted)]
    elif wanted is None:
        parts = [kind == "VOID"]
    elif isinstance(wanted, bool):
        parts = [kind == "BOOLEAN", same("boolean")]
    elif isinstance(wanted, str):
        parts = [kind == "STRING", same("string")]
    else:
        number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        # As doubles large whole numbers would meet their neighbours, as longs fractions would be cut.
        parts = [number, same("double"), *([same("bigint")] if isinstance(wanted, int) else [])]
    return F.coalesce(reduce(and_, parts), F.lit(False))


def containing(rows: DataFrame, column: str, wanted: dict[str, Wanted]) -> DataFrame:
    """Rows whose JSON text in `column` is an object that contains `wanted`; text that isn't JSON contains nothing."""
    return rows.where(holds(F.try_parse_json(column), wanted))
