"""Tables behind displays: quantised columns, fine placement, composite axes, lanes; and neighbour evaluators."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours as N
from .ranges import numbered


def quantised(rows: DataFrame, columns: list[str], top: int = 65_535) -> DataFrame:
    """rows with q_<column>: each column's span as 0 .. top (half-even); a column of one value is 0."""
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    q = lambda c: F.bround((F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-12)) * top, 0).cast("long")
    return rows.crossJoin(F.broadcast(ends)).select(*rows.columns, *[q(c).alias(f"q_{c}") for c in columns])  # one row of ends


def shared_frame(frames: list[tuple[DataFrame, str]], top: int = 65_535) -> list[DataFrame]:
    """Each rows' column quantised in one frame: the span of all of them is 0 .. top."""
    ends = None
    for rows, c in frames:
        one = rows.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
        ends = one if ends is None else ends.union(one)
    ends = F.broadcast(ends.agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")))  # one row
    q = lambda c: F.bround((F.col(c) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)) * top, 0).cast("long")
    return [rows.crossJoin(ends).withColumn(f"q_{c}", q(c)).drop("_lo", "_hi") for rows, c in frames]


def stretched(similarity: Column) -> Column:
    """A similarity as 0 .. 255 by its cube root, so that small ones show."""
    return F.floor(F.least(F.cbrt(F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0))) * 255, F.lit(255.0))).cast("long")


def byte(value: Column, lo: float, hi: float) -> Column:
    """A value's place between lo and hi as 0 .. 255, clipped."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo))) * 255).cast("long")


def fine_place(hits: DataFrame) -> DataFrame:
    """(query, mb): the mean of hits (query, mb, j) weighed by j, half a bin of 0.1 on; without weight the middle of their span."""
    w = F.sum("j")
    return hits.groupBy("query").agg((F.when(w > 0, F.sum(F.col("j") * F.col("mb")) / w + 0.05).otherwise((F.min("mb") + F.max("mb")) / 2)).alias("mb"))


def composite_axis(spots: DataFrame, margin: float = 2.0) -> DataFrame:
    """(chrom, lo, hi, offset): the stretch of each chromosome that spots (chrom, mb) need, laid end to end by chrom."""
    span = spots.groupBy("chrom").agg(F.greatest(F.min("mb") - margin, F.lit(0.0)).alias("lo"), (F.max("mb") + margin).alias("hi"))
    order = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)  # one row a chromosome
    return span.withColumn("offset", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(order), F.lit(0.0)))


def word_place(hits: DataFrame) -> DataFrame:
    """(query, x, y): the mean place of hits (query, x, y, sim) with weights 1 / (1.0001 - sim)."""
    w = 1 / (1.0001 - F.col("sim"))
    return hits.groupBy("query").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


#: The colours of clusters by rank, of noise, and of classes that no track colours or colours too dark; factors and lift of further rounds.
CLUSTER_COLOURS = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")
NOISE_COLOUR = "#dddcd6"
CLASS_COLOURS = {"non_sat": "#c9c8c2", "rDNA": "#8a6d3b"}
DEFAULT_COLOURS = {"ct": "#b9b8b2"}
ROUNDS, LIFT = (0.72, 1.28, 0.5, 1.55), 28


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """Three numbers of 0 to 255 as `#rrggbb`."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0") for c in (r, g, b)])


def class_colours(track: DataFrame) -> DataFrame:
    """(cls, colour) of a track (cls, rgb as `r,g,b`): the median of each channel, rounded down; fixed colours of some classes."""
    part = lambda i: F.floor(F.median(F.get(F.split("rgb", ","), i).cast("int")))
    own = track.where("cls <> ''").groupBy("cls").agg(hex_colour(part(0), part(1), part(2)).alias("colour"))
    table = lambda d: track.sparkSession.createDataFrame(list(d.items()), "cls string, colour string")
    fixed = own.join(F.broadcast(table(CLASS_COLOURS)), "cls", "left_anti").union(table(CLASS_COLOURS))
    return fixed.union(table(DEFAULT_COLOURS).join(own, "cls", "left_anti"))


def cluster_colours(rows: DataFrame) -> DataFrame:
    """(cluster, colour): the largest clusters get the fixed colours, later rounds darker and lighter ones; noise (below 0) its own.

    Clusters of one size come in the order of their numbers.
    """
    sizes = rows.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))
    slots, many = F.array(*[F.lit(c) for c in CLUSTER_COLOURS]), len(CLUSTER_COLOURS)
    placed = numbered(sizes, F.desc("n"), "cluster").withColumn("base", F.get(slots, (F.col("_n") % many).cast("int"))).withColumn("round", F.floor(F.col("_n") / many).cast("int"))
    factor = F.when(F.col("round") == 0, 1.0).otherwise(F.get(F.array(*[F.lit(f) for f in ROUNDS]), (F.col("round") - 1) % len(ROUNDS)))
    channel = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.conv(F.substring("base", 2 * i + 2, 2), 16, 10).cast("int") * factor + F.when(factor > 1, LIFT).otherwise(0))))
    out = placed.select(F.col("cluster").cast("bigint").alias("cluster"), hex_colour(channel(0), channel(1), channel(2)).alias("colour"))
    return out.union(rows.sparkSession.createDataFrame([(-1, NOISE_COLOUR)], "cluster bigint, colour string"))


def first_lanes(lo: np.ndarray, hi: np.ndarray, margin: float) -> np.ndarray:
    """The lane of each span in turn: the first one where it stands over `margin` off what is there.

    Lanes only fill, so spans of one place go on from the lane where the last of them went, and
    what stands near a place is found in a lane's sorted spans.
    """
    starts: list[list[float]] = []
    ends: list[list[float]] = []
    begin: dict[tuple[float, float], int] = {}
    out = np.zeros(len(lo), np.int64)
    for n, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
        at = begin.get((a, b), 0)
        while at < len(starts):
            k = bisect.bisect_left(ends[at], a - margin)  # those before end over `margin` off
            if k == len(starts[at]) or b + margin < starts[at][k]:
                break
            at += 1
        if at == len(starts):
            starts.append([])
            ends.append([])
        k = bisect.bisect_left(starts[at], a)
        starts[at].insert(k, a)
        ends[at].insert(k, b)
        begin[a, b] = at
        out[n] = at
    return out


def lanes(spans: DataFrame, margin: float = 8.0) -> DataFrame:
    """spans (chrom, id, lo, hi) with lane: longest first, each in the first lane where it stands over `margin` off the others.

    Sequential within a chromosome, so one task takes the spans of one (contigs, not reads).
    """

    def pack(pdf):
        pdf = pdf.assign(w=pdf.hi - pdf.lo).sort_values(["w", "id"], ascending=[False, True], kind="stable")
        return pdf.assign(lane=first_lanes(pdf.lo.to_numpy(float), pdf.hi.to_numpy(float), margin))[["chrom", "id", "lo", "hi", "lane"]]

    kind = {f.name: f.dataType.simpleString() for f in spans.schema}
    return spans.groupBy("chrom").applyInPandas(pack, f"chrom {kind['chrom']}, id {kind['id']}, lo double, hi double, lane long")


def knn_accuracy(vectors: DataFrame, k: int = 10, n_folds: int = 5, least: int = 10, exact_rows: int = N.EXACT_ROWS) -> DataFrame:
    """One row (n, accuracy): majority vote of the k nearest of the other folds, over labels of `least` rows or more.

    vectors: (id, z, label). Folds are row numbers within a label modulo n_folds; excluding
    one's own fold is a neighbour search with the fold as chromosome and no distance limit.
    """
    big = vectors.join(vectors.groupBy("label").count().where(F.col("count") >= least).select("label"), "label", "left_semi")
    rows = N.folds(big, n_folds).withColumn("chrom", F.col("fold").cast("long")).withColumn("pos", F.lit(0).cast("long"))
    near = N.neighbours(rows, k, "euclidean", 0, exact_rows).withColumn("sim", F.lit(1.0))
    return N.vote(near, rows.select("id", "label")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))


def knn_r2_many(vectors: DataFrame, values: list[str], k: int = 15, n_folds: int = 5, exact_rows: int = N.EXACT_ROWS) -> DataFrame:
    """One row with the knn_r2() of each of several values (id, z, values), from one search; a value that does not vary in a fold counts as 0 there."""
    n = vectors.count()
    rows = numbered(vectors, "id").withColumn("chrom", F.floor(F.col("_n") * n_folds / F.lit(max(n, 1))).cast("long")).withColumn("pos", F.lit(0).cast("long")).drop("_n")
    near = N.neighbours(rows, k, "euclidean", 0, exact_rows)
    guess = near.join(rows.select(F.col("id").alias("other"), *values), "other").groupBy("id").agg(*[F.avg(v).alias(f"guess_{v}") for v in values])
    r2 = lambda v: F.coalesce(1 - F.sum((F.col(v) - F.col(f"guess_{v}")) ** 2) / F.nullif(F.count("*") * F.var_pop(v), F.lit(0.0)), F.lit(0.0))
    fold = rows.join(guess, "id").groupBy("chrom").agg(*[r2(v).alias(v) for v in values])
    return fold.agg(*[F.avg(v).alias(v) for v in values])


def knn_r2(vectors: DataFrame, value: str, k: int = 15, n_folds: int = 5, exact_rows: int = N.EXACT_ROWS) -> DataFrame:
    """One row (r2): the mean over contiguous folds by id of the R2 of k-nearest-neighbour regression from the other folds."""
    n = vectors.count()
    rows = numbered(vectors, "id").withColumn("chrom", F.floor(F.col("_n") * n_folds / n).cast("long")).drop("_n").withColumn("pos", F.lit(0).cast("long"))
    near = N.neighbours(rows, k, "euclidean", 0, exact_rows)
    guess = near.join(rows.select(F.col("id").alias("other"), F.col(value).alias("v")), "other").groupBy("id").agg(F.avg("v").alias("guess"))
    both = rows.join(guess, "id")
    fold = both.groupBy("chrom").agg((1 - F.sum((F.col(value) - F.col("guess")) ** 2) / (F.count("*") * F.var_pop(value))).alias("r2"))
    return fold.agg(F.avg("r2").alias("r2"))


def sweep(d: np.ndarray, grid: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, float]], list[tuple[int, int, int, int, float, bool]]]:
    """HDBSCAN over a grid of (min_cluster, min_samples): settings with clusters and noise, and pairs of settings.

    A pair has the adjusted Rand index of the points that both cluster, and whether the two
    are adjacent: of one min_cluster, or of one min_samples and neighbouring min_clusters.
    """
    from .cluster import hdbscan

    return compared([hdbscan(d, size, samples)[0] for size, samples in grid], grid)


def compared(found: list[np.ndarray], grid: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, float]], list[tuple[int, int, int, int, float, bool]]]:
    """sweep() of the labels that each setting gave."""
    settings = [(a, b, int(x.max() + 1), float((x < 0).mean())) for (a, b), x in zip(grid, found)]
    sizes, pairs = sorted({a for a, _ in grid}), []
    for i, (a, b) in enumerate(grid):
        for j in range(i):
            c, e = grid[j]
            both = (found[i] >= 0) & (found[j] >= 0)
            table = np.zeros((found[i].max() + 1, found[j].max() + 1))
            np.add.at(table, (found[i][both], found[j][both]), 1)
            two = lambda x: float((x * (x - 1) / 2).sum())
            n, index, sa, sb = table.sum(), two(table), two(table.sum(1)), two(table.sum(0))
            chance = sa * sb / max(n * (n - 1) / 2, 1)
            ari = 1.0 if (sa + sb) / 2 == chance else float((index - chance) / ((sa + sb) / 2 - chance))
            pairs.append((c, e, a, b, ari, a == c or (b == e and abs(sizes.index(a) - sizes.index(c)) == 1)))
    return settings, pairs
