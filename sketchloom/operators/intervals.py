"""Interval operators: coverage by bins, merging, dominant classes and arms.

intervals: (chrom, start, end, grp), half open; bins: (chrom, bin, start, end) of one width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(intervals: DataFrame, dim: DataFrame, width: int, lengths: DataFrame) -> DataFrame:
    """(chrom, bin, grp, frac): summed overlap of each group over the bin's length.

    A range join as an equi-join: an interval is dealt to the bins it touches. Overlapping
    intervals count twice. Intervals of unknown chromosomes go, the rest is clipped.
    """
    clipped = intervals.join(lengths, "chrom").select("chrom", "grp", F.greatest("start", F.lit(0)).alias("s"), F.least("end", "length").alias("e")).where("e > s")
    dealt = clipped.select("chrom", "grp", "s", "e", F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"(e - 1) div {width}"))).alias("bin"))
    part = dealt.join(dim, ["chrom", "bin"]).select("chrom", "bin", "grp", (F.least("e", "end") - F.greatest("s", "start")).alias("o"), (F.col("end") - F.col("start")).alias("len"))
    return part.groupBy("chrom", "bin", "grp").agg((F.sum("o") / F.max("len")).alias("frac"))


def merged(intervals: DataFrame) -> DataFrame:
    """(chrom, start, end): unions of intervals that overlap or touch."""
    order = Window.partitionBy("chrom").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= far, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return intervals.select("chrom", "start", "end", island.alias("island")).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def dominant(shares: DataFrame, order: list, least: float = 0.3) -> DataFrame:
    """(chrom, bin, label, frac): the class with the largest share, the first of `order` on ties; "" under `least`."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("grp"))
    best = shares.where(place > 0).groupBy("chrom", "bin").agg(F.max(F.struct("frac", (-place).alias("p"), "grp")).alias("b"))
    return best.select("chrom", "bin", F.when(F.col("b.frac") >= least, F.col("b.grp").cast("string")).otherwise("").alias("label"), F.col("b.frac").alias("frac"))


def arms(dim: DataFrame, alpha: DataFrame) -> DataFrame:
    """(chrom, bin, arm) by a bin's middle against the extent of its chromosome's alpha intervals; q without any."""
    extent = alpha.groupBy("chrom").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    middle = (F.col("start") + F.col("end")) / 2
    arm = F.when(F.col("lo").isNull(), "q").when(middle < F.col("lo"), "p").when(middle > F.col("hi"), "q").otherwise("cen")
    return dim.join(F.broadcast(extent), "chrom", "left").select("chrom", "bin", arm.alias("arm"))


def flags(shares: DataFrame, dim: DataFrame, telomere, repeats: list) -> DataFrame:
    """(chrom, bin, telo, rm_total, rm_<group>...) of every bin: telomere where its share is above 0, repeat shares clipped to 0 .. 1."""
    clip = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    of = lambda g: F.sum(F.when(F.col("grp") == g, F.col("frac")))
    wide = shares.groupBy("chrom", "bin").agg(of(telomere).alias("t"), F.sum(F.when(F.col("grp").isin(repeats), F.col("frac"))).alias("all"), *[of(g).alias(f"g_{g}") for g in repeats])
    out = dim.select("chrom", "bin").join(wide, ["chrom", "bin"], "left")
    return out.select("chrom", "bin", (F.coalesce("t", F.lit(0.0)) > 0).alias("telo"), clip(F.col("all")).alias("rm_total"), *[clip(F.col(f"g_{g}")).alias(f"rm_{g}") for g in repeats])


def parent_class(shares: DataFrame, dim: DataFrame, factor: int, order: list, least: float = 0.3) -> DataFrame:
    """(chrom, parent, label, frac): the class with the largest mean share over a parent's bins, as dominant()."""
    many = dim.groupBy("chrom", F.expr(f"bin div {factor}").alias("parent")).agg(F.count("*").alias("n"))
    mean = shares.groupBy("chrom", F.expr(f"bin div {factor}").alias("parent"), "grp").agg(F.sum("frac").alias("s")).join(many, ["chrom", "parent"])
    return dominant(mean.select("chrom", F.col("parent").alias("bin"), "grp", (F.col("s") / F.col("n")).alias("frac")), order, least).withColumnRenamed("bin", "parent")
