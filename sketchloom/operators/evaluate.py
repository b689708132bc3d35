"""Measures: agreement of labelings, rank statistics, purity, explained variance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import accumulated, first_rows


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def chance(rows: DataFrame, label: str) -> DataFrame:
    """(n, chance): the share of the most common label."""
    return rows.groupBy(label).agg(F.count("*").alias("m")).agg(F.sum("m").alias("n"), (F.max("m") / F.sum("m")).alias("chance"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari): the adjusted Rand index of two labelings; 1 where both are trivial alike."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = confusion(rows, a, b)
    own = both.agg(two("n").alias("index"), F.sum("n").alias("all"))
    sides = [both.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n").alias(n)) for c, n in ((a, "sa"), (b, "sb"))]
    one = own.crossJoin(sides[0]).crossJoin(sides[1])  # one row each
    expected = F.col("sa") * F.col("sb") / (F.col("all") * (F.col("all") - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("index") - expected) / (most - expected)).alias("ari"))


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> float:
    """AMI with the arithmetic mean of entropies. The contingency table comes to the driver: one row a pair of labels."""
    table = [tuple(r) for r in confusion(rows, a, b).collect()]
    n = sum(r[2] for r in table)
    left: dict = {}
    right: dict = {}
    for x, y, m in table:
        left[x], right[y] = left.get(x, 0) + m, right.get(y, 0) + m
    entropy = lambda d: -sum(m / n * math.log(m / n) for m in d.values())
    mutual = sum(m / n * math.log(n * m / (left[x] * right[y])) for x, y, m in table)
    fact = lambda i: math.lgamma(i + 1)
    expected = 0.0
    for p in left.values():
        for q in right.values():
            for m in range(max(1, p + q - n), min(p, q) + 1):
                chance_ = fact(p) + fact(q) + fact(n - p) + fact(n - q) - fact(n) - fact(m) - fact(p - m) - fact(q - m) - fact(n - p - q + m)
                expected += m / n * math.log(n * m / (p * q)) * math.exp(chance_)
    mean = (entropy(left) + entropy(right)) / 2
    return 1.0 if abs(mean - expected) < 1e-15 else (mutual - expected) / (mean - expected)


def average_ranks(counts: DataFrame, value: str) -> DataFrame:
    """Average ranks of distinct values (value, n): (value, n, rank), ties sharing the mean.

    Values are dealt to ranges; a range is ranked in one task and starts where the ranges
    before it end, so no task orders all values.
    """
    return accumulated(counts, value).withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2).drop("_before")


def auc_by(rows: DataFrame, groups: list[str], score: str, positive: str) -> DataFrame:
    """(groups, auc) of small groups: rank-based, ties sharing average ranks; null without rows of both kinds."""
    by = rows.groupBy(*groups, score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    order = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumn("rank", F.sum("n").over(order) - (F.col("n") - 1) / 2)
    n1, n0 = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return ranked.groupBy(*groups).agg(((F.sum(F.col("rank") * F.col("p")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (auc): rank-based, ties sharing average ranks. Scores are counted by value before they are ranked."""
    by = rows.groupBy(score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    n1, n0 = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return average_ranks(by, score).agg(((F.sum(F.col("rank") * F.col("p")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


def _corr(x: str, y: str) -> Column:
    """Pearson's correlation, NaN where a side does not vary: F.corr() divides by 0 there, which ANSI mode refuses."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    varies = lambda c: F.sqrt(F.var_pop(F.when(both, F.col(c).cast("double"))))
    return F.coalesce(F.covar_pop(x, y) / F.nullif(varies(x) * varies(y), F.lit(0.0)), F.when(F.count_if(both) > 0, F.lit(float("nan"))))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson and Spearman correlation, slope and intercept of y on x; a correlation is NaN where a side does not vary."""
    ranked = rows
    for c, r in ((x, "rx"), (y, "ry")):
        ranked = ranked.join(average_ranks(rows.groupBy(c).agg(F.count("*").alias("n")), c).select(c, F.col("rank").alias(r)), c)
    return ranked.agg(_corr(x, y).alias("pearson"), _corr("rx", "ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def cluster_table(rows: DataFrame) -> DataFrame:
    """Rows (cluster, cls, chrom, gc[, bp, sd, private]) as one row a cluster of 0 or more, largest first.

    Size (and Mb of bp), dominant class and chromosome with their shares, means of gc, sd
    and private. The most common class and chromosome, the first by name on ties.
    """
    own = rows.where("cluster >= 0")
    more = [F.avg(c).alias(c) for c in ("sd", "private") if c in rows.columns] + ([(F.sum("bp") / 1e6).alias("mb")] if "bp" in rows.columns else [])
    total = own.groupBy("cluster").agg(F.count("*").alias("n_bins"), F.avg("gc").alias("gc"), F.count_distinct("chrom").alias("n_chroms"), *more)
    extra = [c for c in ("mb", "sd", "private") if c in total.columns]
    for c, n in (("cls", "dom_class"), ("chrom", "dom_chrom")):
        by = own.groupBy("cluster", c).agg(F.count("*").alias("m"))
        top = by.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("m"), c))).where("r = 1")
        total = total.join(top.select("cluster", F.col(c).alias(n), F.col("m").alias(f"{n}_n")), "cluster")
    return total.select("cluster", "n_bins", "dom_class", (F.col("dom_class_n") / F.col("n_bins")).alias("dom_class_frac"), "n_chroms", "dom_chrom", (F.col("dom_chrom_n") / F.col("n_bins")).alias("dom_chrom_frac"), "gc", *extra).orderBy(F.desc("n_bins"), "cluster")


def purity(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n_bins") * F.col("dom_class_frac")) / F.sum("n_bins")).alias("purity"))


def recovered(rows: DataFrame, classes: list[str]) -> DataFrame:
    """One row (recovered): of the rows (cluster, cls) of some classes, the share that lies in a cluster of 0 or more."""
    return rows.where(F.col("cls").isin(classes)).agg((F.count_if(F.col("cluster") >= 0) / F.greatest(F.count("*"), F.lit(1))).alias("recovered"))


def parent_majority(rows: DataFrame) -> DataFrame:
    """(parent, child): the most common cluster of 0 or more of each parent, the smallest on ties; -1 where there is none."""
    by = rows.where("child >= 0").groupBy("parent", "child").agg(F.count("*").alias("n"))
    top = by.groupBy("parent").agg(F.max(F.struct("n", (-F.col("child")).alias("c"))).alias("b")).select("parent", (-F.col("b.c")).alias("child"))
    return rows.select("parent").distinct().join(top, "parent", "left").select("parent", F.coalesce("child", F.lit(-1)).alias("child"))


def sampled_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """At most `most` pairs (a, b), by the MD5 of their names: a sampling operator."""
    return first_rows(pairs, most, F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))), "a", "b")


def explained(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row (explained): 1 - the sum of squares within clusters over the whole."""
    within = rows.groupBy(cluster).agg((F.count(value) * F.var_pop(value)).alias("w")).agg(F.sum("w").alias("w"))
    return within.crossJoin(rows.agg((F.count(value) * F.var_pop(value)).alias("t"))).select((1 - F.col("w") / F.col("t")).alias("explained"))


def close_recall(pairs: DataFrame, near: str, by: str, share: float) -> DataFrame:
    """One row (n, recall): of the pairs nearest by `near`, the part that is nearest by `by` too; ties by (a, b)."""
    n = pairs.count()
    top = max(1, math.ceil(n * share))
    first, second = (first_rows(pairs, top, F.desc(c), "a", "b").select("a", "b") for c in (near, by))
    return first.join(second.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def agreement(pairs: DataFrame, exact: str, model: str, near: float, within: float) -> DataFrame:
    """One row (n, spearman, recall) of pairs (a, b) with two distances.

    recall: of the `near` share that is closest by the exact distance, the part that lies
    among the `within` share closest by the model; ties by (a, b).
    """
    n = pairs.count()
    first, second = (first_rows(pairs, max(1, math.ceil(n * share)), c, "a", "b").select("a", "b") for c, share in ((exact, near), (model, within)))
    hit = first.join(second.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return correlation(pairs, exact, model).select(F.lit(n).cast("long").alias("n"), "spearman").crossJoin(hit)  # one row each


def whitened(z: Column, sigma: list[float], alpha: float) -> Column:
    """Components divided by sigma^alpha; a sigma of 0 or less counts as 1."""
    return F.zip_with(z, F.array(*[F.lit((s if s > 0 else 1.0) ** alpha) for s in sigma]), lambda a, b: a / b)


def unit(z: Column) -> Column:
    """A vector over its length, which counts as 1e-9 at least."""
    norm = F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(z, lambda x: x / F.greatest(norm, F.lit(1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best_setting(rows: DataFrame, base: str, slack: float = 0.02, health: tuple[str, ...] = ("health",)) -> DataFrame:
    """rows (tag, health.., score) with able (each health within `slack` of the base's) and best: the able one with the largest score, the first tag on ties."""
    floor = lambda c: F.max(F.when(F.col("tag") == base, F.col(c))).over(Window.partitionBy())  # noqa: E731  a row a setting: few
    able = F.lit(True)
    for c in health:
        able &= F.col(c) >= floor(c) - slack
    order = Window.partitionBy("able").orderBy(F.desc("score"), "tag")
    return rows.withColumn("able", able).withColumn("best", F.col("able") & (F.row_number().over(order) == 1))
