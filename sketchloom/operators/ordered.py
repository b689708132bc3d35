"""Operators on ordered positions: gaps, periods, chains, jumps, runs, order statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges as R

#: Edges of the period bands: 89 bands of equal ratio from 60 to 100,000.
EDGES = [float(x) for x in np.geomspace(60, 100_000, 90)]
MIN_GAPS = 15


def gaps(hits: DataFrame) -> DataFrame:
    """(contig, pos, gap): distance from each hit to the next of the same hash in its contig."""
    nxt = F.lead("pos").over(Window.partitionBy("contig", "h").orderBy("pos"))
    return hits.select("contig", "pos", (nxt - F.col("pos")).alias("gap")).where("gap is not null")


def periods(hits: DataFrame, bin_bp: int, least: int = MIN_GAPS) -> DataFrame:
    """(contig, bin, period, strength) of bins with `least` gaps or more.

    Gaps lie within one bin and between the first and last edge. The band with most gaps,
    the first on ties, gives the period (the median of its gaps) and the strength (its
    share); bands under a third of `least` give none.
    """
    edges = F.array(*[F.lit(e) for e in EDGES])
    own = gaps(hits).withColumn("bin", F.expr(f"pos div {bin_bp}")).where((F.col("gap") >= EDGES[0]) & (F.col("gap") < EDGES[-1]) & (F.expr(f"(pos + gap) div {bin_bp}") == F.col("bin")))
    own = own.withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("gap"))) - 1)
    bands = own.groupBy("contig", "bin", "band").agg(F.count("*").alias("n"), F.median("gap").alias("period"))
    best = bands.groupBy("contig", "bin").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("band")).alias("b"), "period")).alias("top"))
    return best.where((F.col("total") >= least) & (F.col("top.n") >= least // 3)).select("contig", "bin", F.col("top.period").alias("period"), (F.col("top.n") / F.col("total")).alias("strength"))


def loci(hits: DataFrame, gap: int, most: int = 3) -> DataFrame:
    """(query, rank, chrom, start, end, sim, n): chains of hits (query, chrom, start, end, score) no further apart than `gap`.

    Distance is from start to start with the hit before, by (chrom, start); chains are
    transitive, ranked by their best score, then by place.
    """
    order = Window.partitionBy("query", "chrom").orderBy("start", F.desc("score"))
    new = F.when(F.col("start") - F.lag("start").over(order) <= gap, 0).otherwise(1)
    chain = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    got = hits.withColumn("new", new).withColumn("chain", chain).groupBy("query", "chrom", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("sim"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "chrom", "start")).cast("long")
    return got.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "rank", "chrom", "start", "end", "sim", "n")


def jumps(windows: DataFrame, far: float = 5.0) -> DataFrame:
    """(contig, jumps): placed windows (contig, w, chrom, mb) whose predecessor lies on another chromosome or over `far` away."""
    order = Window.partitionBy("contig").orderBy("w")
    broken = (F.lag("chrom").over(order) != F.col("chrom")) | (F.abs(F.lag("mb").over(order) - F.col("mb")) > far)
    return windows.select("contig", F.coalesce(broken, F.lit(False)).alias("b")).groupBy("contig").agg(F.count_if("b").alias("jumps"))


def novelty_runs(scan: DataFrame, bar: float = 0.9, least: int = 3) -> DataFrame:
    """(contig, w0, w1, n, mincov): each contig's longest run of consecutive windows with cover under `bar`, the first on ties."""
    order = Window.partitionBy("contig").orderBy("w")
    low = scan.where(F.col("cover") < bar)
    runs = low.withColumn("island", F.col("w") - F.row_number().over(order)).groupBy("contig", "island").agg(F.min("w").alias("w0"), F.max("w").alias("w1"), F.count("*").alias("n"), F.min("cover").alias("mincov")).where(F.col("n") >= least)
    best = F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("n"), "w0"))
    return runs.withColumn("r", best).where("r = 1").select("contig", "w0", "w1", "n", "mincov")


def signs(values: np.ndarray, tie: float) -> int:
    """Rising less falling pairs of a sequence, by merging sorted halves; differences up to `tie` count as none."""
    own, total, size = np.array(values, float), 0, 64
    for at in range(0, len(own), size):  # short runs pair by pair
        d = own[None, at : at + size] - own[at : at + size, None]
        total += int(np.triu(np.sign(d) * (np.abs(d) > tie), 1).sum())
        own[at : at + size] = np.sort(own[at : at + size])
    while size < len(own):
        for at in range(0, len(own) - size, 2 * size):
            right = own[at + size : at + 2 * size]
            u, many = np.unique(own[at : at + size], return_counts=True)
            ends, top = np.append(0, many.cumsum()), len(u) - 1
            # the difference decides, as it does pair by pair: a search for the rounded bound may be one place off
            k = np.searchsorted(u, right - tie, "left")
            k += (k <= top) & (right - u[np.minimum(k, top)] > tie)
            k -= (k > 0) & ~(right - u[np.maximum(k - 1, 0)] > tie)
            m = np.searchsorted(u, right + tie, "right")
            m -= (m > 0) & (u[np.maximum(m - 1, 0)] - right > tie)
            m += (m <= top) & ~(u[np.minimum(m, top)] - right > tie)
            total += int(ends[k].sum()) - int((ends[-1] - ends[m]).sum())
            own[at : at + 2 * size] = np.sort(own[at : at + 2 * size], kind="stable")
        size *= 2
    return total


def long_tau(values: Column, tie: float = 0.01) -> Column:
    """tau_a() for long arrays: n log n steps in Arrow batches."""

    @F.pandas_udf("double")
    def op(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else signs(np.array(v), tie) / (len(v) * (len(v) - 1) / 2) if len(v) > 1 else 0.0)

    return op(values)


def ordered_tau(w: Column, mb: Column, n: Column, tie: float = 0.01) -> Column:
    """long_tau() of the values mb at the places w, arrays in the order of w, among n rows: pairs of one w have no order and count as none; null without any ordered pair."""

    @F.pandas_udf("double")
    def op(places: pd.Series, values: pd.Series, many: pd.Series) -> pd.Series:
        def one(w: np.ndarray, mb: np.ndarray, m: int) -> float | None:
            if m < 2:
                return 0.0
            if not len(w) or w[0] == w[-1]:
                return None
            alike = np.flatnonzero(np.diff(w) == 0)
            groups = np.unique(w[alike]) if len(alike) else []
            return (signs(mb, tie) - sum(signs(mb[w == x], tie) for x in groups)) / (m * (m - 1) / 2)

        return pd.Series([one(w, mb, m) for w, mb, m in zip(places, values, many)], dtype="Float64")

    return op(w, mb, n)


def tau_a(values: Column, tie: float = 0.01) -> Column:
    """Kendall's tau-a of a short array in its order; differences up to `tie` count as none; 0 under two values."""
    n = F.size(values)
    later = lambda x, i: F.aggregate(F.slice(values, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0), lambda a, y: a + F.when(F.abs(y - x) > tie, F.signum(y - x)).otherwise(0).cast("int"))
    total = F.aggregate(F.transform(values, later), F.lit(0), lambda a, x: a + x)
    return F.when(n < 2, 0.0).otherwise(total / (n * (n - 1) / 2))


def local_tau(windows: DataFrame, slide: int = 7) -> DataFrame:
    """(contig, min_tau): the least tau of `slide` windows in a row on one chromosome; 0 if there are none."""
    order = Window.partitionBy("contig").orderBy("w").rowsBetween(0, slide - 1)
    span = windows.select("contig", F.collect_list("mb").over(order).alias("mbs"), F.min("chrom").over(order).alias("a"), F.max("chrom").over(order).alias("b"))
    tau = F.when((F.size("mbs") == slide) & (F.col("a") == F.col("b")), tau_a(F.col("mbs")))
    return span.select("contig", tau.alias("t")).groupBy("contig").agg(F.coalesce(F.min("t"), F.lit(0.0)).alias("min_tau"))


def best_run(windows: DataFrame, cap: int) -> DataFrame:
    """(contig, w0, w1, hits): the `cap` windows in a row with most hits, then the largest sum of j, then the first."""
    order = Window.partitionBy("contig").orderBy("w")
    ahead = order.rowsBetween(0, cap - 1)
    run = windows.select("contig", F.col("w").alias("w0"), F.last("w").over(ahead).alias("w1"), F.sum(F.col("hit").cast("int")).over(ahead).alias("hits"), F.sum("j").over(ahead).alias("sj"), F.count("*").over(ahead).alias("n"), F.count("*").over(Window.partitionBy("contig")).alias("all"))
    run = run.where(F.col("n") == F.least("all", F.lit(cap)))
    return run.withColumn("r", F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("hits"), F.desc("sj"), "w0"))).where("r = 1").select("contig", "w0", "w1", "hits")


def thinned(windows: DataFrame, cap: int) -> DataFrame:
    """At most `cap` windows of each contig, evenly by rank: the distinct half-even roundings of a line from 0 to n - 1."""
    order = Window.partitionBy("contig").orderBy("w")
    ranked = windows.withColumn("i", F.row_number().over(order) - 1).withColumn("n_all", F.count("*").over(Window.partitionBy("contig")))
    wanted = F.when(F.col("n_all") <= cap, F.array(F.col("i").cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.bround(k * ((F.col("n_all") - 1) / F.lit(float(cap - 1))), 0).cast("long")))
    return ranked.where(F.array_contains(wanted, F.col("i").cast("long"))).drop("i")


#: Fixed value: bases of one alpha monomer.
MONOMER = 170.8


def period_summary(rows: DataFrame, strong: float = 0.3, least: int = 10, least_rdna: int = 5) -> DataFrame:
    """One row of rows (live, rdna, period, strength): the live arrays' median period, in monomers, the periodic share, the rDNA's median.

    live, rdna: whether a bin is of that class. Figures of under `least` (`least_rdna`)
    periodic bins are null.
    """
    live, rdna = F.col("live") & (F.col("strength") > strong), F.col("rdna") & (F.col("strength") > strong)
    n, m = F.count_if(live), F.count_if(rdna)
    middle = lambda on: F.lit(R.median(rows.where(on), "period")).cast("double")
    got = rows.agg(F.when(n >= least, middle(live)).alias("live_period"), F.when(n >= least, F.round(n / F.greatest(F.count_if("live"), F.lit(1)), 3)).alias("live_periodic"), F.when(m >= least_rdna, F.round(middle(rdna), 1)).alias("rdna_period"))
    return got.select(F.round("live_period", 1).alias("live_period"), F.round(F.col("live_period") / MONOMER, 2).alias("live_monomers"), "live_periodic", "rdna_period")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, place): distinct keys numbered from 0 in the order in which `order` first shows them."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return R.numbered(first, "_first", key).select(key, F.col("_n").cast("long").alias("place"))
