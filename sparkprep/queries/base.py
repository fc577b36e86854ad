"""A registry of queries and their SQL. Doubles are compared at the seven digits of a float on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


def coarse(df: DataFrame) -> DataFrame:
    """Doubles to seven digits, and what is next to nothing to 0, so that the order of a sum does not show."""
    fix = {f.name: F.when(F.abs(F.col(f"`{f.name}`")) < 1e-9, 0.0).otherwise(F.col(f"`{f.name}`").cast("float").cast("double")) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns(fix) if fix else df


class Book:
    """Queries of one area."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, doubles: str = "") -> None:
        """doubles: the SQL's floating columns, separated by blanks."""
        self.queries[name] = lambda spark, sf_dir: coarse(query(spark, sf_dir))
        if sql is not None:
            fix = ", ".join(f'CASE WHEN abs("{c}") < 1e-9 THEN 0.0::DOUBLE ELSE CAST(CAST("{c}" AS FLOAT) AS DOUBLE) END AS "{c}"' for c in doubles.split())
            self.sql[name] = f"SELECT * REPLACE ({fix}) FROM ({sql})" if fix else sql
