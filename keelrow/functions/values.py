"""Python values as typed constants, independent of time zones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose text form is exact, so a bound read from the data can be put into a filter.
_EXACT = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampNTZType)


def constant(value, dtype: T.DataType) -> Column:
    """A literal of a column's type; a datetime stays what it says for columns without a zone."""
    if isinstance(value, datetime) and isinstance(dtype, T.TimestampNTZType):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(value).cast(dtype)


class Ranges:
    """Lowest and highest values of some columns: one aggregate, one row to the driver."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self._types = {c: df.schema[c].dataType for c in columns}
        self._columns = [c for c in columns if isinstance(self._types[c], _EXACT)]
        bounds = [f(c).cast("string").alias(f"{f.__name__}_{c}") for c in self._columns for f in (F.min, F.max)]
        self._row = df.agg(*bounds).first() if bounds else None

    def cut(self, df: DataFrame, column: str, own: str) -> DataFrame:
        """Rows whose column lies in the range of ``own``; the filter reaches the scan."""
        if own not in self._columns:
            return df
        low, high = self._row[f"min_{own}"], self._row[f"max_{own}"]
        if low is None:
            return df.filter(F.lit(False))
        dtype = self._types[own]
        return df.filter(F.col(column).between(constant(low, dtype), constant(high, dtype)))
