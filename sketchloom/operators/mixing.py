"""Mixing of chromosomes in word space: who the nearest others are, and what they vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours as N


def promiscuity(vectors: DataFrame, k: int = 15, apart: int = 5, least: int = 50, exact_rows: int = N.EXACT_ROWS) -> DataFrame:
    """(id, chrom, promiscuity, vote) of vectors (id, z, chrom, pos), all of one group of chromosomes.

    promiscuity: the share of another chromosome among the k nearest that are not next to
    the row on its own. vote: the chromosome with the largest sum of similarities (at least
    0 each), the smallest on ties; a row without such neighbours votes for its own. No rows
    for groups of under `least`.
    """
    near = N.neighbours(vectors, k, apart=apart, exact_rows=exact_rows).join(vectors.select(F.col("id").alias("other"), F.col("chrom").alias("of")), "other")
    own = vectors.select("id", "chrom")
    both = near.join(own, "id")
    share = both.groupBy("id").agg(F.avg((F.col("of") != F.col("chrom")).cast("int")).alias("promiscuity"))
    cast = both.groupBy("id", "of").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("w"))
    win = cast.groupBy("id").agg(F.max(F.struct("w", (-F.col("of")).alias("c"))).alias("b")).select("id", (-F.col("b.c")).alias("vote"))
    out = own.join(share, "id", "left").join(win, "id", "left").select("id", "chrom", F.coalesce("promiscuity", F.lit(0.0)).alias("promiscuity"), F.coalesce("vote", "chrom").alias("vote"))
    return out if own.count() >= least else out.limit(0)


def promiscuity_summary(rows: DataFrame, classes: DataFrame, least: int = 10) -> DataFrame:
    """(cls, n, promiscuity, vote_acc): of each class (id, cls) with `least` rows or more, and of all rows as "all"."""
    each = rows.join(classes, "id").select(F.explode(F.array(F.col("cls"), F.lit("all"))).alias("cls"), "promiscuity", (F.col("vote") == F.col("chrom")).cast("int").alias("right"))
    got = each.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("promiscuity"), 4).alias("promiscuity"), F.round(F.avg("right"), 4).alias("vote_acc"))
    return got.where((F.col("n") >= least) | (F.col("cls") == "all"))


def supported(rows: DataFrame, label: str, least: int) -> DataFrame:
    """The rows whose label has `least` rows or more."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(label))).where(F.col("_n") >= least).drop("_n")


#: The support that each measure asks for, of a label's rows or of all rows.
SUPPORT = {"chromosome": 5, "family": 20, "class": 10}
LEAST_ROWS = {"alpha": 25, "satellite": 100}


def guarded(rows: DataFrame, least: int) -> DataFrame:
    """rows, or none of them if they are under `least`: a measure of so few has no value."""
    return rows if rows.limit(least).count() >= least else rows.limit(0)
