"""Registration of a query, the shape of its result and the SQL that checks it.

A shape lists ``name:type`` pairs: ``s`` text, ``l`` whole number, ``d`` number rounded to 6 digits, ``d4``
or another digit count where given. Both engines deliver exactly that shape, so results compare as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _fields(shape: str) -> list[tuple[str, str, int]]:
    fields = []
    for item in shape.split():
        name, kind = item.split(":")
        fields.append((name, kind[0], int(kind[1:] or 6) if kind[0] == "d" else 0))
    return fields


def shaped(df: DataFrame, shape: str) -> DataFrame:
    def out(name: str, kind: str, digits: int) -> Column:
        if kind == "d":
            return F.round(F.col(name).cast("double"), digits).alias(name)
        return F.col(name).cast("string" if kind == "s" else "bigint").alias(name)

    return df.select(*[out(*field) for field in _fields(shape)])


def shaped_sql(body: str, shape: str, ctes: tuple[str, ...]) -> str:
    def out(name: str, kind: str, digits: int) -> str:
        if kind == "d":
            return f"round(CAST({name} AS DOUBLE), {digits}) AS {name}"
        return f"CAST({name} AS {'VARCHAR' if kind == 's' else 'BIGINT'}) AS {name}"

    columns = ", ".join(out(*field) for field in _fields(shape))
    parts = [*dict.fromkeys(ctes), f"result AS ({body.strip()})"]
    return "WITH " + ",\n".join(parts) + f"\nSELECT {columns} FROM result"


def query(name: str, shape: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register the decorated function under a name; without SQL only its rows are checked."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: shaped(build(spark, folder), shape)
        if sql is not None:
            ORACLES[name] = shaped_sql(sql, shape, ctes)
        return build

    return register
