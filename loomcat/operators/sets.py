"""Union and column order."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def merge_datasets(datasets: list[DataFrame]) -> DataFrame:
    """Concatenate data sets with differing columns; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def sorted_header(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order."""
    return df.select(*sorted(df.columns))


def filter_rows(df: DataFrame, predicate, columns: list[str] | None = None) -> DataFrame:
    """Rows satisfying a Column, a SQL text, or, as the slow path, a Python function of the row.

    A Python function gets a Row of the named columns, or of all; only these are sent to Python, in
    Arrow batches. Rows where it gives None or False are dropped.
    """
    if isinstance(predicate, (Column, str)):
        return df.filter(predicate)
    names = list(columns or df.columns)

    @F.arrow_udf("boolean")
    def accepts(*values: pa.Array) -> pa.Array:
        rows = zip(*(v.to_pylist() for v in values), strict=True)
        row = Row(*names)
        return pa.array([bool(predicate(row(*r))) for r in rows], pa.bool_())

    return df.filter(accepts(*(F.col(f"`{n}`") for n in names)))


def by_brand(df: DataFrame, brand: str) -> DataFrame:
    """Rows of one brand; the filter reaches the Parquet scan."""
    return df.filter(F.col("brand") == brand)
