"""Shaping of query results: plain types, rounded doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Integers as bigint, decimals as double, doubles rounded (``special`` sets digits for single columns)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
