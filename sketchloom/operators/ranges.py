"""Order statistics by ranges: rows are dealt to ranges of their order, and no task holds or orders all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _ranged(rows: DataFrame, order: list[Column], weight: Column) -> DataFrame:
    """rows with _part, the range that holds them, and _before, the weight of all ranges before it."""
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = parts.groupBy("_part").agg(F.sum(weight).alias("_all"))  # one row a range
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(ends.select("_part", before.alias("_before"))), "_part")


def _columns(order: tuple[str | Column, ...]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with _n, their place from 0 in an order that tells all rows apart."""
    by = _columns(order)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return _ranged(rows, by, F.lit(1)).withColumn("_n", F.col("_before") + place - 1).drop("_part", "_before")


def first_rows(rows: DataFrame, many: int, *order: str | Column) -> DataFrame:
    """The first `many` rows of an order, by their numbers: any share of the rows may be asked for."""
    return numbered(rows, *order).where(F.col("_n") < many).drop("_n")


def accumulated(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """counts (value, n) of distinct values with _before, how many rows have a smaller value."""
    own = F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    return _ranged(counts, [F.col(value)], F.col(n)).withColumn("_before", F.col("_before") + own).drop("_part")


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """The exact quantiles of a column, interpolated between neighbours; nulls do not count, and of no rows there are none.

    Equal values are counted first, then the ranges that hold the ranks give up to two rows a share.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = accumulated(counts, "v")
    total = placed.agg(F.max(F.col("_before") + F.col("n"))).first()[0]
    if not total:
        return [None] * len(shares)
    at = sorted({i for s in shares for i in (math.floor(s * (total - 1)), math.ceil(s * (total - 1)))})
    asked = F.explode(F.array(*[F.lit(i).cast("long") for i in at])).alias("i")
    got = {r["i"]: r["v"] for r in placed.select("v", "n", "_before", asked).where((F.col("i") >= F.col("_before")) & (F.col("i") < F.col("_before") + F.col("n"))).collect()}
    out: list[float | None] = []
    for s in shares:
        low, part = math.floor(s * (total - 1)), s * (total - 1) % 1
        out.append(got[low] + part * (got[math.ceil(s * (total - 1))] - got[low]))
    return out


def median(rows: DataFrame, value: str) -> float | None:
    return quantiles(rows, value, [0.5])[0]
