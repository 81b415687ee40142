"""JSON and CSV outputs named by brand and time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.operators.sets import sorted_header


def output_path(folder: str, label: str, moment: datetime, kind: str) -> str:
    """Path of one output: lower-case label with underscores, and the time stamp."""
    name = label.lower().replace(" ", "_")
    return f"{folder.rstrip('/')}/{name}_{moment:%Y%m%d_%H%M%S}.{kind}"


def write_json(df: DataFrame, folder: str, label: str, moment: datetime) -> str:
    """Write one object per line, characters unescaped; gives the path."""
    path = output_path(folder, label, moment, "json")
    df.write.json(path)
    return path


def csv_columns(df: DataFrame) -> DataFrame:
    """Columns sorted by name, nested values as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return sorted_header(df).select(
        *(
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in sorted_header(df).schema
        )
    )


def write_csv(df: DataFrame, folder: str, label: str, moment: datetime) -> str:
    """Write with a header of all columns in order; nothing, and an empty path, without rows.

    The rows are counted by the write itself; a folder that it left empty is removed again.
    """
    path = output_path(folder, label, moment, "csv")
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    made = not files.exists(place.getParent())
    written = Observation()
    rows = csv_columns(df).observe(written, F.count(F.lit(1)).alias("n"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    if written.get["n"]:
        return path
    files.delete(place, True)
    if made and not files.listStatus(place.getParent()):
        files.delete(place.getParent(), False)
    return ""
