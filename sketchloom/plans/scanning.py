"""Queries of scan operators. orders stand in for a scan: customers are contigs, orders their windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import scans as C
from .base import query, read

BIN_BP, REF_BINS, PER_CHROM = 100_000, 500, 50
SQL_SCAN = f"""s0 AS (SELECT o_custkey % 300 AS contig, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderkey) AS rn FROM orders),
s1 AS (SELECT contig, contig % 3 AS sample, rn + rn // 7 AS w, 0.801 + (k % 23) / 100 AS cover, (k % 10) / 10 AS j1, (contig * 7 + rn * 3 * (contig % 5 - 2)) % 500 AS t FROM s0),
scan AS (SELECT contig, sample, w, cover, j1, list_transform(range(0, 8), lambda i: ((t + 500) % 500 + i * 37) % 500) AS ehits, list_transform(range(0, 8), lambda i: j1 * (1 - i * 0.08)) AS ejacc FROM s1),
places AS (SELECT b AS bin, b // {PER_CHROM} AS chrom, (b % {PER_CHROM}) * 0.1 + 0.03 AS mb, b % {PER_CHROM} >= 40 AS sat FROM range(0, {REF_BINS}) r(b)),
placed AS (SELECT s.*, ehits[1] AS top, p.chrom, p.mb, p.sat, j1 >= 0.1 AS placed FROM scan s JOIN places p ON p.bin = ehits[1])"""


def scan(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("contig"), F.col("o_orderkey").alias("k"))
    rn = F.row_number().over(Window.partitionBy("contig").orderBy("k")).cast("long")
    rows = rows.withColumn("rn", rn).select("contig", (F.col("contig") % 3).alias("sample"), F.expr("rn + rn div 7").alias("w"), (0.801 + F.col("k") % 23 / 100).alias("cover"), (F.col("k") % 10 / 10).alias("j1"), ((F.col("contig") * 7 + F.col("rn") * 3 * (F.col("contig") % 5 - 2)) % 500).alias("t"))
    i = F.sequence(F.lit(0), F.lit(7))
    return rows.select("contig", "sample", "w", "cover", F.transform(i, lambda x: ((F.col("t") + 500) % 500 + x * 37) % 500).alias("ehits"), F.transform(i, lambda x: F.col("j1") * (1 - x * F.lit(0.08))).alias("ejacc"))


def places(spark):
    b = F.col("id")
    return spark.range(REF_BINS).select(b.alias("bin"), F.expr(f"id div {PER_CHROM}").alias("chrom"), (b % PER_CHROM * F.lit(0.1) + 0.03).alias("mb"), (b % PER_CHROM >= 40).alias("sat"))


_SQL_TAU = """pairs AS (SELECT a.contig, sum(CASE WHEN abs(b.mb - a.mb) > 0.01 THEN sign(b.mb - a.mb) ELSE 0 END) AS s FROM dw a JOIN dw b ON a.contig = b.contig AND a.w < b.w GROUP BY a.contig)"""
#: From the CTEs scan and placed.
SQL_TRIAGE_STEPS = f"""base AS (SELECT contig, count(*) AS n_win, count(*) FILTER (WHERE placed) AS n_placed, median(j1) AS j_med, median(cover) AS cover_med, avg(CASE WHEN cover < 0.9 THEN 1 ELSE 0 END) AS novel,
  arg_min(CASE WHEN NOT placed THEN 'unplaced' WHEN sat THEN 'satellite' ELSE 'non-sat' END, w) AS end5, arg_max(CASE WHEN NOT placed THEN 'unplaced' WHEN sat THEN 'satellite' ELSE 'non-sat' END, w) AS end3 FROM placed GROUP BY contig HAVING count(*) >= 3),
dom AS (SELECT contig, chrom, n AS dom_n FROM (SELECT contig, chrom, count(*) AS n, row_number() OVER (PARTITION BY contig ORDER BY count(*) DESC, chrom) AS r FROM placed WHERE placed GROUP BY contig, chrom) WHERE r = 1),
dw AS (SELECT p.contig, p.w, p.mb, d.chrom, d.dom_n FROM placed p JOIN dom d ON p.contig = d.contig AND p.chrom = d.chrom WHERE p.placed), {_SQL_TAU},
walk AS (SELECT dw.contig, chrom, dom_n, min(mb) AS lo, max(mb) AS hi, CASE WHEN dom_n >= 5 THEN max(s) / (dom_n * (dom_n - 1) / 2) END AS tau FROM dw LEFT JOIN pairs USING (contig) GROUP BY dw.contig, chrom, dom_n),
j AS (SELECT contig, count(*) FILTER (WHERE b) AS jumps FROM (SELECT contig, lag(chrom) OVER o <> chrom OR abs(lag(mb) OVER o - mb) > 5 AS b FROM placed WHERE placed WINDOW o AS (PARTITION BY contig ORDER BY w)) GROUP BY contig),
runs AS (SELECT contig, min(w) AS w0, max(w) AS w1, count(*) AS n, min(cover) AS mincov FROM (SELECT contig, w, cover, w - row_number() OVER (PARTITION BY contig ORDER BY w) AS i FROM scan WHERE cover < 0.9) GROUP BY contig, i HAVING count(*) >= 3),
nov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY n DESC, w0) AS r FROM runs) WHERE r = 1),
triage AS (SELECT base.contig, n_win, round_even(n_win * 0.1, 1) AS mb, coalesce(walk.chrom, -1) AS dom_chrom, round_even(coalesce(dom_n / n_placed, 0), 2) AS dom_frac, round_even(lo, 1) AS span_lo, round_even(hi, 1) AS span_hi, round_even(tau, 2) AS tau,
  CASE WHEN n_placed = 0 THEN 'unplaced' WHEN dom_n < 5 THEN 'short' WHEN tau >= 0.85 THEN 'forward' WHEN tau <= -0.85 THEN 'reverse' WHEN tau >= 0.5 THEN 'mostly+' WHEN tau <= -0.5 THEN 'mostly-' ELSE 'scrambled' END AS orient,
  coalesce(jumps, 0) AS jumps, round_even(j_med, 2) AS j_med, round_even(cover_med, 2) AS cover_med, end5, end3, round_even(novel, 3) AS novel_frac,
  round_even(w0 * 0.1, 1) AS novel_run_mb0, round_even((w1 + 1) * 0.1, 1) AS novel_run_mb1, round_even(mincov, 2) AS novel_run_mincov
  FROM base LEFT JOIN walk USING (contig) LEFT JOIN j USING (contig) LEFT JOIN nov USING (contig))"""
SQL_TRIAGE = f"WITH {SQL_SCAN}, {SQL_TRIAGE_STEPS}"


@query(f"{SQL_TRIAGE} SELECT * FROM triage")
def k8_triage(spark, sf_dir):
    return C.triage(scan(spark, sf_dir), places(spark), BIN_BP)


_SQL_ENDS = lambda t: f"(count(*) FILTER (WHERE n_win >= 5 AND end5 = '{t}') + count(*) FILTER (WHERE n_win >= 5 AND end3 = '{t}'))"
_SQL_CENSUS = ", ".join(f"count(*) FILTER (WHERE n_win >= 5 AND orient = '{o}') AS n_{n}" for o, n in (("forward", "forward"), ("reverse", "reverse"), ("mostly+", "mostly_plus"), ("mostly-", "mostly_minus"), ("scrambled", "scrambled"), ("short", "short"), ("unplaced", "unplaced")))


def sql_summary(n_bins: str) -> str:
    """summary() from the CTEs scan and triage."""
    return f"""a AS (SELECT count(*) AS n_windows, round(avg(CASE WHEN j1 >= 0.3 THEN 1 ELSE 0 END), 3) AS placed_confident, round(avg(CASE WHEN j1 >= 0.1 AND j1 < 0.3 THEN 1 ELSE 0 END), 3) AS placed_weak, round(avg(CASE WHEN j1 < 0.1 THEN 1 ELSE 0 END), 3) AS unplaced,
  round(count(DISTINCT ehits[1]) / {n_bins}, 3) AS ref_breadth, round(count(*) FILTER (WHERE cover < 0.9) * 0.1, 1) AS novel_mb FROM scan),
b AS (SELECT count(*) AS n_contigs_reported, round({_SQL_ENDS('satellite')} / greatest(2 * count(*) FILTER (WHERE n_win >= 5), 1), 3) AS ends_in_satellite, round({_SQL_ENDS('unplaced')} / greatest(2 * count(*) FILTER (WHERE n_win >= 5), 1), 3) AS ends_unplaced, {_SQL_CENSUS} FROM triage)
SELECT * FROM a, b"""


@query(f"{SQL_TRIAGE}, {sql_summary(str(REF_BINS))}")
def f22_triage_summary(spark, sf_dir):
    rows = scan(spark, sf_dir)
    return C.summary(C.triage(rows, places(spark), BIN_BP), rows, REF_BINS, BIN_BP)


@query(f"""WITH {SQL_SCAN}, runs AS (SELECT contig, min(w) AS w0, max(w) AS w1, count(*) AS n, min(cover) AS mincov FROM (SELECT contig, w, cover, w - row_number() OVER (PARTITION BY contig ORDER BY w) AS i FROM scan WHERE cover < 0.9) GROUP BY contig, i HAVING count(*) >= 3)
SELECT contig, w0, w1, n, round(mincov, 6) AS mincov FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY n DESC, w0) AS r FROM runs) WHERE r = 1""")
def g4_novelty_runs(spark, sf_dir):
    return O.novelty_runs(scan(spark, sf_dir)).withColumn("mincov", F.round("mincov", 6))


@query(f"""WITH {SQL_SCAN}, o AS (SELECT contig, w, chrom, mb, row_number() OVER (PARTITION BY contig ORDER BY w) AS i FROM placed WHERE placed),
spans AS (SELECT a.contig, a.i, sum(CASE WHEN b.i < c.i AND abs(c.mb - b.mb) > 0.01 THEN sign(c.mb - b.mb) ELSE 0 END) / 21 AS tau, min(least(b.chrom, c.chrom)) AS lo, max(greatest(b.chrom, c.chrom)) AS hi, count(*) AS n
  FROM o a JOIN o b ON a.contig = b.contig AND b.i BETWEEN a.i AND a.i + 6 JOIN o c ON a.contig = c.contig AND c.i BETWEEN a.i AND a.i + 6 GROUP BY a.contig, a.i)
SELECT contig, round(coalesce(min(tau) FILTER (WHERE n = 49 AND lo = hi), 0), 6) AS min_tau FROM spans GROUP BY contig""")
def g5_local_tau(spark, sf_dir):
    rows = C.placed(scan(spark, sf_dir), places(spark)).where("placed")
    return O.local_tau(rows).withColumn("min_tau", F.round("min_tau", 6))


@query(f"""WITH {SQL_SCAN}, h AS (SELECT contig, w, ehits[1] BETWEEN 100 AND 299 AS hit, k10 AS j FROM (SELECT *, CAST(round(ejacc[1] * 10) AS BIGINT) AS k10 FROM scan)),
r AS (SELECT contig, w AS w0, last_value(w) OVER a AS w1, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER a AS hits, sum(j) OVER a AS sj, count(*) OVER a AS n, count(*) OVER (PARTITION BY contig) AS total FROM h WINDOW a AS (PARTITION BY contig ORDER BY w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT contig, w0, w1, CAST(hits AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY hits DESC, sj DESC, w0) AS i FROM r WHERE n = least(total, 10)) WHERE i = 1""")
def g6_best_run(spark, sf_dir):
    rows = C.in_region(scan(spark, sf_dir), 100, 299)
    return O.best_run(rows.select("contig", "w", "hit", F.round(F.col("j") * 10).cast("long").alias("j")), 10)


@query(f"""WITH {SQL_SCAN}, i AS (SELECT contig, w, row_number() OVER (PARTITION BY contig ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY contig) AS n_all FROM scan)
SELECT contig, w, n_all FROM i WHERE n_all <= 12 OR list_contains(list_transform(range(0, 12), lambda k: CAST(round_even(k * ((n_all - 1) / 11), 0) AS BIGINT)), i)""")
def g7_thinning(spark, sf_dir):
    return O.thinned(scan(spark, sf_dir).select("contig", "w"), 12)


@query(f"""WITH {SQL_SCAN}, h AS (SELECT contig, w, ehits[1] AS top FROM scan), best AS (SELECT contig, min(w) AS lo, max(w) AS hi FROM h WHERE top BETWEEN 150 AND 349 GROUP BY contig HAVING count(*) >= 15 ORDER BY count(*) * ((max(top) - min(top)) * 0.1) DESC, contig LIMIT 1),
m AS (SELECT h.*, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n_all FROM h JOIN best USING (contig) WHERE w BETWEEN lo AND hi)
SELECT contig, w, top, n_all FROM m WHERE n_all <= 20 OR list_contains(list_transform(range(0, 20), lambda k: CAST(round_even(k * ((n_all - 1) / 19), 0) AS BIGINT)), i)""")
def k14_contig_picker(spark, sf_dir):
    return C.whole_chromosome(scan(spark, sf_dir), 150, 349, BIN_BP, 20).select("contig", "w", "top", "n_all")


_REGIONS = [("p_arm", 0, 39), ("array", 100, 199), ("q_end", 400, 499)]
_SQL_SHOW = " UNION ALL ".join(
    f"""SELECT '{n}' AS id, contig, w0, w1, hits FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, sj DESC, w0) AS i FROM (
  SELECT contig, w AS w0, last_value(w) OVER a AS w1, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER a AS BIGINT) AS hits, sum(j) OVER a AS sj, count(*) OVER a AS n, count(*) OVER () AS total FROM (
    SELECT h.contig, w, top BETWEEN {lo} AND {hi} AS hit, j FROM h JOIN (SELECT contig, min(w) AS lo, max(w) AS hi FROM h WHERE top BETWEEN {lo} AND {hi} GROUP BY contig HAVING count(*) >= 8 ORDER BY count(*) DESC, contig LIMIT 1) b ON h.contig = b.contig AND w BETWEEN lo AND hi)
  WINDOW a AS (ORDER BY w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE n = least(total, 16)) WHERE i = 1"""
    for n, lo, hi in _REGIONS
)


@query(f"WITH {SQL_SCAN}, h AS (SELECT contig, w, ehits[1] AS top, round(ejacc[1] * 10) AS j FROM scan) {_SQL_SHOW}")
def k13_showcase(spark, sf_dir):
    rows = scan(spark, sf_dir).withColumn("ejacc", F.transform("ejacc", lambda x: F.round(x * 10)))
    return C.showcase(rows, _REGIONS, 16)


@query(f"WITH {SQL_SCAN} SELECT sample, chrom, count(*) AS n, round_even(median(cover), 3) AS cover FROM placed WHERE sat GROUP BY ALL HAVING count(*) >= 5")
def f24_centromere_meter(spark, sf_dir):
    return C.centromere_meter(scan(spark, sf_dir), places(spark))


@query(f"""WITH {SQL_SCAN}, f AS (SELECT sample, chrom, len(list_filter(range(2, 9), lambda i: ehits[i] // 50 <> chrom AND list_contains([1, 3, 5, 7], ehits[i] // 50) AND ejacc[i] >= 0.5 * j1)) > 0 AS prom, len(list_filter(ehits, lambda b: b // 50 <> chrom)) = 0 AND ejacc[8] >= 0.5 * j1 AS own FROM placed WHERE sat AND chrom IN (1, 3, 5, 7))
SELECT sample, chrom, count(*) AS n, round(avg(CASE WHEN prom THEN 1 ELSE 0 END), 3) AS promiscuous, round(avg(CASE WHEN own AND NOT prom THEN 1 ELSE 0 END), 3) AS censored FROM f GROUP BY ALL HAVING count(*) >= 5""")
def f25_commons(spark, sf_dir):
    return C.commons(scan(spark, sf_dir), places(spark), [1, 3, 5, 7], PER_CHROM)


@query(f"""WITH {SQL_SCAN} SELECT contig, w, round(ejacc[1] / greatest(coalesce(ejacc[list_filter(range(2, 9), lambda i: ehits[i] // 50 <> ehits[1] // 50 OR abs(ehits[i] - ehits[1]) > 10)[1]], ejacc[8]), 0.0001), 6) AS margin FROM scan""")
def g12_placement_margin(spark, sf_dir):
    alt = C.distant_alternative(F.col("ehits"), F.col("ejacc"), PER_CHROM, 10)
    return scan(spark, sf_dir).select("contig", "w", F.round(F.element_at("ejacc", 1) / F.greatest(alt, F.lit(0.0001)), 6).alias("margin"))
