"""Flat text form of nested results, for engine-independent comparison.

The library returns real arrays of structs; the registry renders them as
``a|b|c;a|b|c`` text so that the same value can be produced by plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render_array(df: DataFrame, keep: Sequence[str], arr: str, fields: Sequence[str]) -> DataFrame:
    text = F.array_join(
        F.transform(F.col(arr), lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";")
    return df.select(*keep, F.size(arr).cast("bigint").alias(f"n_{arr}"), text.alias(f"{arr}_text"))


def sql_render(fields: Sequence[str], order: str, alias: str) -> str:
    """DuckDB side of ``render_array``: string_agg in position order."""
    parts = ", ".join(f"CAST({f} AS VARCHAR)" for f in fields)
    return (f"CAST(COUNT(*) AS BIGINT) AS n_{alias}, "
            f"string_agg(concat_ws('|', {parts}), ';' ORDER BY {order}) AS {alias}_text")


def nested_sql(source: str, key: str, order: str, fields: Sequence[str], alias: str, chunk: int = 1000) -> str:
    """DuckDB form of ``nest_ordered`` + ``render_array``: positions per key, chunks, text."""
    pos = f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) AS pos FROM {source}"
    return (f"SELECT {key}, CAST((pos - 1) // {chunk} AS INTEGER) AS chunk_no, {sql_render(fields, 'pos', alias)} "
            f"FROM ({pos}) GROUP BY {key}, (pos - 1) // {chunk}")
