"""NaN means "could not be measured"; every operator treats it as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(c: Column | str) -> Column:
    """A double column with NaN as NULL (Spark orders NaN above all numbers and compares it as greater)."""
    return F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """All float columns with NaN as NULL; meant for every place where data comes in."""
    floats = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats) if floats else df
