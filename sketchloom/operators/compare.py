"""Reads placed by words against reads aligned by others. Alignments are an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges as R
from .evaluate import correlation

CONFIDENT, MARGIN = 50, 2.0


def best_alignment(alignments: DataFrame, first_bin: DataFrame, bin_bp: int) -> DataFrame:
    """(read, mm_chrom, mm_bin, mm_mapq, mm_ident): each read's primary alignment with the most matches, the first by place, then quality, on ties.

    alignments: (read, chrom, start, end, mapq, mlen, blen, is_primary); one outside the
    chromosomes of first_bin (chrom, bin0) counts as none. The bin is that of the middle.
    """
    order = Window.partitionBy("read").orderBy(F.desc("mlen"), "chrom", "start", F.desc("mapq"), "blen")
    top = alignments.where("is_primary").withColumn("r", F.row_number().over(order)).where("r = 1")
    return top.join(F.broadcast(first_bin), "chrom").select("read", F.col("chrom").alias("mm_chrom"), (F.col("bin0") + F.expr(f"((start + end) div 2) div {bin_bp}")).alias("mm_bin"), F.col("mapq").alias("mm_mapq"), (F.col("mlen") / F.greatest("blen", F.lit(1))).alias("mm_ident"))


def joined(reads: DataFrame, best: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """reads (read, len, our_bin, our_chrom, our_j, our_alt_j, our_cover) with their alignment, if any, the error meter and the margin."""
    sat = places.select(F.col("bin").alias("mm_bin"), F.col("sat").alias("mm_sat"))
    out = reads.join(best, "read", "left").join(sat, "mm_bin", "left")
    return out.withColumn("our_err", 1 - F.pow("our_cover", F.lit(1.0 / k))).withColumn("margin", F.col("our_j") / F.greatest("our_alt_j", F.lit(1e-4)))


def concordance(rows: DataFrame) -> DataFrame:
    """One row of joined() rows: how placements agree with confident alignments, with and without weak margins.

    Confident: mapping quality of 50 or more outside satellites. Figures without a row are null.
    """
    aligned, sat = F.col("mm_bin").isNotNull(), F.coalesce("mm_sat", F.lit(False))
    conf = aligned & (F.col("mm_mapq") >= CONFIDENT) & ~sat
    same, kept = F.col("our_chrom") == F.col("mm_chrom"), F.col("margin") >= MARGIN
    middle = lambda what, digits, on=F.lit(True): F.round(F.lit(R.median(rows.where(on), what)).cast("double"), digits)
    share = lambda what, on, d=4: F.round(F.avg(F.when(on, what.cast("int"))), d)
    return rows.agg(
        F.count("*").alias("n_reads"), middle("len", 4).alias("read_len_median"), middle("mm_ident", 4, aligned).alias("mm_identity_median"), F.count_if(conf).alias("n_confident"),
        share(same, conf).alias("chrom"), share(F.abs(F.col("our_bin") - F.col("mm_bin")) <= 1, conf).alias("bin_pm1"), F.count_if(aligned & sat).alias("n_satellite"), share(F.col("mm_mapq") >= 20, aligned & sat, 3).alias("mm_conf_frac"), share(same, aligned & sat, 3).alias("sat_chrom"),
        F.count_if(~aligned).alias("unaligned"), middle("margin", 2, conf & same).alias("correct_margin_median"), F.round(F.max(F.when(conf & ~same, F.col("margin"))), 3).alias("worst_discordant_margin"), share(~kept, conf).alias("abstain_frac"), share(same, conf & kept).alias("kept_chrom"),
    )


def error_meter(rows: DataFrame) -> DataFrame:
    """One row: Pearson and Spearman correlation, slope and intercept of the error meter on 1 - identity."""
    return correlation(rows.where("mm_bin is not null").select((1 - F.col("mm_ident")).alias("x"), F.col("our_err").alias("y")), "x", "y")
