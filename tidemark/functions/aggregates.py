"""The eight aggregates as Column expressions.

COUNT of rows or values; SUM of nothing is 0; AVG, MIN, MAX of nothing are NULL;
DISTINCT counts NULL as a value; STDDEV is of the population; GEOMEAN is over
positive values only. No aggregate raises: a sum of integers that overflows is summed
as doubles and goes to the nearest bound; AVG, STDDEV and GEOMEAN of what is not a
number are NULL, SUM is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import NUMBERS, fitted

NAMES = ("count", "sum", "avg", "min", "max", "distinct", "stddev", "geomean")


def output_name(func: str, column: str | None) -> str:
    return func if column is None else f"{func}_{column.rpartition('.')[2]}"


def aggregate(func: str, c: Column | None, spark_type: str = "double") -> Column:
    if func == "count":
        return F.count(F.lit(1) if c is None else c)
    number = spark_type in NUMBERS
    if func in ("avg", "stddev", "geomean") and not number:
        c = F.lit(None).cast("double")
    if func == "sum":
        zero = F.lit(0).cast("bigint")
        if not number:
            return zero + F.count(F.lit(None))
        if spark_type == "bigint":
            return F.coalesce(F.try_sum(c), fitted(F.sum(c.cast("double")), "double", "bigint"), zero)
        return F.coalesce(F.sum(c), F.lit(0.0) if spark_type in ("double", "float") else zero)
    if func == "avg":
        return F.avg(c.cast("double") if spark_type == "bigint" else c)
    if func == "min":
        return F.min(c)
    if func == "max":
        return F.max(c)
    if func == "distinct":
        return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)).cast("bigint")
    if func == "stddev":
        return F.stddev_pop(c)
    if func == "geomean":
        return F.exp(F.avg(F.when(c > 0, F.ln(c))))
    raise ValueError(f"unknown aggregate {func}")
