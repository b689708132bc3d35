"""Queries of interval and order operators; star-schema tables stand in for tracks and walks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import intervals as I
from ..operators import ordered as O
from .base import query, read

WIDTH = 30
_SQL_DAY = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"
SQL_TRACK = f"SELECT l_returnflag || l_linestatus AS chrom, {_SQL_DAY} AS start, {_SQL_DAY} + CAST(l_quantity AS BIGINT) AS \"end\", l_linenumber AS grp FROM lineitem"
SQL_DIM = f"""lengths AS (SELECT chrom, max("end") AS length FROM track GROUP BY chrom),
dim AS (SELECT chrom, b AS bin, b * {WIDTH} AS start, least((b + 1) * {WIDTH}, length) AS "end" FROM (SELECT chrom, length, unnest(range(0, (length - 1) // {WIDTH} + 1)) AS b FROM lengths))"""
SQL_COVER = f"""WITH track AS ({SQL_TRACK}), {SQL_DIM},
cov AS (SELECT t.chrom, d.bin, t.grp, sum(least(t."end", d."end") - greatest(t.start, d.start)) / max(d."end" - d.start) AS frac
  FROM track t JOIN dim d ON t.chrom = d.chrom AND t.start < d."end" AND t."end" > d.start GROUP BY ALL)"""


def track(spark, sf_dir):
    """lineitem as intervals: flags are the chromosome, days since 1992 the place, line numbers the group."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("chrom"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").alias("grp"))


def dimension(rows):
    lengths = rows.groupBy("chrom").agg(F.max("end").alias("length"))
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {WIDTH}")))
    dim = lengths.select("chrom", "length", b.alias("bin")).select("chrom", "bin", (F.col("bin") * WIDTH).alias("start"), F.least((F.col("bin") + 1) * WIDTH, F.col("length")).alias("end"))
    return lengths, dim


def shares(spark, sf_dir):
    rows = track(spark, sf_dir)
    lengths, dim = dimension(rows)
    return I.coverage(rows, dim, WIDTH, lengths)


@query(f"{SQL_COVER} SELECT chrom, bin, grp, round(frac, 6) AS frac FROM cov")
def e5_interval_coverage(spark, sf_dir):
    return shares(spark, sf_dir).withColumn("frac", F.round("frac", 6))


@query("""WITH t AS (SELECT l_partkey AS chrom, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
f AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM t),
g AS (SELECT *, sum(CASE WHEN s <= far THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT chrom, min(s) AS start, max(e) AS "end" FROM g GROUP BY chrom, island""")
def f10_interval_merge(spark, sf_dir):
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return I.merged(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chrom"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end")))


@query(f"""{SQL_COVER} SELECT chrom, bin, CASE WHEN frac >= 0.3 THEN CAST(grp AS VARCHAR) ELSE '' END AS label, round(frac, 6) AS frac
FROM (SELECT *, row_number() OVER (PARTITION BY chrom, bin ORDER BY frac DESC, array_position([3, 1, 2, 5, 4, 7, 6], grp)) AS r FROM cov) WHERE r = 1""")
def f11_dominant_class(spark, sf_dir):
    return I.dominant(shares(spark, sf_dir), [3, 1, 2, 5, 4, 7, 6]).withColumn("frac", F.round("frac", 6))


@query(f"""WITH track AS ({SQL_TRACK}), {SQL_DIM}, alpha AS (SELECT chrom, min(start) AS lo, max("end") AS hi FROM track WHERE grp = 7 AND start > 900 AND "end" < 1500 AND chrom <> 'RF' GROUP BY chrom)
SELECT dim.chrom, bin, CASE WHEN lo IS NULL THEN 'q' WHEN (start + "end") / 2 < lo THEN 'p' WHEN (start + "end") / 2 > hi THEN 'q' ELSE 'cen' END AS arm FROM dim LEFT JOIN alpha ON dim.chrom = alpha.chrom""")
def e8_arm_call(spark, sf_dir):
    rows = track(spark, sf_dir)
    return I.arms(dimension(rows)[1], rows.where("grp = 7 and start > 900 and end < 1500 and chrom <> 'RF'"))


_NAMES = ["hor_1_5(S1C1/5/19H1L)", "hor_9_2(S4C9H2)", "dhor_22_1(S2C22H2_d)", "mon_13_1(mixedAlp)", "ct_1_1(p_arm)", "censat_1_1(rnd-6_family-4384)", "hsat1A_13_2", "rDNA_13_1", "hsat3_X_1(x)", "mystery_1_1(z)"]
_REPEATS = [("SINE", "AluY"), ("LINE", "L1PA2"), ("Retroposon", "SVA_D"), ("LINE", "L2"), ("SINE", "MIR"), ("LTR", "ERVL"), ("LTR?", "x"), ("DNA", "hAT"), ("RC", "Helitron"), ("Satellite", "centr"), ("Simple_repeat", "(TTAGGG)n"), ("Low_complexity", "A-rich"), ("Unknown", "z")]


@query(f"""SELECT name, CASE WHEN head = 'hor' THEN CASE WHEN ends_with(token, 'L') THEN 'asat_hor_live' ELSE 'asat_hor' END WHEN head = 'dhor' THEN 'asat_dhor' WHEN head = 'mon' THEN 'asat_mon' WHEN head = 'censat' THEN 'other_sat'
  WHEN head IN ('hsat1A', 'hsat1B', 'hsat2', 'hsat3', 'bsat', 'gsat', 'rDNA', 'ct') THEN head ELSE '' END AS cls
FROM (SELECT name, regexp_replace(regexp_extract(name, '^([^(]*)', 1), '(?:_(?:[0-9]+|[XYMxym]))+$', '') AS head, regexp_replace(regexp_extract(name, '\\((.*)$', 1), '\\)$', '') AS token FROM (VALUES {", ".join(f"('{n}')" for n in _NAMES)}) v(name))""")
def c11_censat_class(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", L.satellite_class(F.col("name")).alias("cls"))


@query(f"""SELECT rclass, family, CASE WHEN family LIKE 'Alu%' THEN 'alu' WHEN family LIKE 'L1%' THEN 'l1' WHEN rclass = 'Retroposon' OR family LIKE 'SVA%' THEN 'sva' WHEN rclass = 'LINE' THEN 'line_other' WHEN rclass = 'SINE' THEN 'sine_other'
  WHEN rclass LIKE 'LTR%' THEN 'ltr' WHEN rclass LIKE 'DNA%' OR rclass = 'RC' THEN 'dna' WHEN rclass = 'Satellite' THEN 'sat_rm' WHEN rclass IN ('Simple_repeat', 'Low_complexity') THEN 'simple' ELSE 'other_rm' END AS grp
FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _REPEATS)}) v(rclass, family)""")
def c12_repeat_group(spark, sf_dir):
    return spark.createDataFrame(_REPEATS, "rclass string, family string").select("rclass", "family", L.repeat_group(F.col("rclass"), F.col("family")).alias("grp"))


_BIN_S = 432_000
_SQL_SEC = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"""WITH hits AS (SELECT event_type AS contig, user_id % 7 AS h, {_SQL_SEC} AS pos FROM events),
g AS (SELECT contig, pos, lead(pos) OVER (PARTITION BY contig, h ORDER BY pos) - pos AS gap FROM hits),
own AS (SELECT contig, pos // {_BIN_S} AS bin, gap FROM g WHERE gap >= {O.EDGES[0]!r} AND gap < {O.EDGES[-1]!r} AND (pos + gap) // {_BIN_S} = pos // {_BIN_S}),
banded AS (SELECT contig, bin, gap, len(list_filter({O.EDGES!r}, lambda e: e <= gap)) - 1 AS band FROM own),
bands AS (SELECT contig, bin, band, count(*) AS n, median(gap) AS period FROM banded GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY contig, bin) AS total, row_number() OVER (PARTITION BY contig, bin ORDER BY n DESC, band) AS r FROM bands)
SELECT contig, bin, period, round(n / total, 6) AS strength FROM ranked WHERE r = 1 AND total >= 15 AND n >= 5""")
def f13_periodicity(spark, sf_dir):
    hits = read(spark, sf_dir, "events").select(F.col("event_type").alias("contig"), (F.col("user_id") % 7).alias("h"), F.unix_timestamp("ts").alias("pos"))
    return O.periods(hits, _BIN_S).withColumn("strength", F.round("strength", 6))


@query(f"""WITH hits AS (SELECT user_id AS query, event_type AS chrom, {_SQL_SEC} AS start, {_SQL_SEC} + 3600 AS "end", value AS score FROM events),
n AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY query, chrom ORDER BY start, score DESC) <= 259200 THEN 0 ELSE 1 END AS new FROM hits),
c AS (SELECT *, sum(new) OVER (PARTITION BY query, chrom ORDER BY start, score DESC ROWS UNBOUNDED PRECEDING) AS chain FROM n),
l AS (SELECT query, chrom, chain, min(start) AS start, max("end") AS "end", max(score) AS sim, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, chrom, start) AS rank FROM l)
SELECT query, rank, chrom, start, "end", sim, n FROM r WHERE rank <= 3""")
def g2_chain_loci(spark, sf_dir):
    sec = F.unix_timestamp("ts")
    hits = read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_type").alias("chrom"), sec.alias("start"), (sec + 3600).alias("end"), F.col("value").alias("score"))
    return O.loci(hits, 259_200)


@query("""WITH p AS (SELECT l_orderkey AS contig, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS w, l_returnflag AS chrom, l_partkey / 100 AS mb FROM lineitem WHERE l_quantity >= 5),
b AS (SELECT contig, lag(chrom) OVER o <> chrom OR abs(lag(mb) OVER o - mb) > 5 AS broken FROM p WINDOW o AS (PARTITION BY contig ORDER BY w))
SELECT contig, count(*) FILTER (WHERE broken) AS jumps FROM b GROUP BY contig""")
def g3_order_jumps(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_quantity >= 5")
    w = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag"))
    return O.jumps(rows.select(F.col("l_orderkey").alias("contig"), w.alias("w"), F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") / 100).alias("mb")))


@query("""WITH v AS (SELECT l_orderkey AS contig, l_linenumber * 1000000 + l_partkey AS w, l_partkey / 100 AS mb FROM lineitem),
s AS (SELECT a.contig, sum(CASE WHEN abs(b.mb - a.mb) > 0.01 THEN sign(b.mb - a.mb) ELSE 0 END) AS s FROM v a JOIN v b ON a.contig = b.contig AND a.w < b.w GROUP BY a.contig),
n AS (SELECT contig, count(*) AS n FROM v GROUP BY contig)
SELECT n.contig, n, round(CASE WHEN n < 2 THEN 0 ELSE s / (n * (n - 1) / 2) END, 6) AS tau FROM n LEFT JOIN s USING (contig)""")
def k4_kendall_tau(spark, sf_dir):
    line = F.struct((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("w"), (F.col("l_partkey") / 100).alias("mb"))
    walk = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("contig")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(line["w"].isNotNull(), line))).alias("v"))
    return walk.select("contig", "n", F.round(O.ordered_tau(F.col("v.w"), F.col("v.mb"), F.col("n")), 6).alias("tau"))
