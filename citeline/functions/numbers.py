"""Rounding as Python does it."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _round3(values: pd.Series) -> pd.Series:
    return values.map(lambda v: round(v, 3), na_action="ignore")


def round3(value: Column) -> Column:
    """Three decimals by the exact binary value, ties to even: 0.0625 becomes
    0.062, where Spark's own ``round`` says 0.063. For reports of a few rows."""
    return _round3(value.cast("double"))
