"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(column: str | Column) -> Column:
    """A double with NaN read as null, so that aggregates skip it."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c), c)


def fips_text(column: str | Column) -> Column:
    """A county code as five digits: blanks trimmed, a lost leading zero restored, else null."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    digits = F.regexp_extract(c, r"^([0-9]{1,5})(?:\.0)?$", 1)
    return F.when(digits != "", F.lpad(digits, 5, "0"))
