"""Queries of judgements on clusters, arms, reads and names, and of the sinks' round trips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import compare as R
from ..operators import display as D
from ..operators import evaluate as E
from ..operators import intervals as I
from ..operators import mixing as X
from ..operators import ordered as O
from ..operators import project as P
from ..operators import scans as C
from ..operators import sketch as K
from ..operators.linear import gram
from ..params import Params
from ..session import new_folder
from ..sources import files
from .base import BIN, KMER, SCALED, SQL_STORE, contigs, doc_store, query, read, sql_hits
from .measuring import SQL_CLUSTERS, SQL_VEC, clustered, vectors
from .ordering import SQL_COVER, dimension, shares, track
from .scanning import BIN_BP, PER_CHROM, SQL_SCAN, SQL_TRIAGE, places, scan

_SQL_ACRO = f"""WITH {SQL_VEC}, g AS (SELECT * FROM v WHERE chrom BETWEEN 1 AND 5), near AS (SELECT * FROM (SELECT a.id, a.chrom, b.chrom AS of, list_cosine_similarity(a.z, b.z) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.z, b.z) DESC, b.id) AS r
  FROM g a JOIN g b ON a.id <> b.id AND NOT (a.chrom = b.chrom AND abs(a.pos - b.pos) <= 5)) WHERE r <= 15),
share AS (SELECT id, avg(CASE WHEN of <> chrom THEN 1 ELSE 0 END) AS promiscuity FROM near GROUP BY id), cast_ AS (SELECT id, of, row_number() OVER (PARTITION BY id ORDER BY sum(greatest(sim, 0)) DESC, of) AS r FROM near GROUP BY id, of),
acro AS (SELECT g.id, g.chrom, label, coalesce(promiscuity, 0) AS promiscuity, coalesce(of, g.chrom) AS vote FROM g LEFT JOIN share USING (id) LEFT JOIN (SELECT id, of FROM cast_ WHERE r = 1) w USING (id))"""


def acro(spark, sf_dir):
    return X.promiscuity(vectors(spark, sf_dir).where("chrom between 1 and 5"))


@query(f"{_SQL_ACRO} SELECT id, chrom, round(promiscuity, 6) AS promiscuity, vote FROM acro")
def k7_acro_mixing(spark, sf_dir):
    """Five chromosomes of the embeddings as the group of arms."""
    return acro(spark, sf_dir).withColumn("promiscuity", F.round("promiscuity", 6))


@query(f"{_SQL_ACRO}, e AS (SELECT CAST(label AS VARCHAR) AS cls, promiscuity, vote = chrom AS ok FROM acro UNION ALL SELECT 'all', promiscuity, vote = chrom FROM acro) SELECT cls, count(*) AS n, round(avg(promiscuity), 4) AS promiscuity, round(avg(CAST(ok AS INT)), 4) AS vote_acc FROM e GROUP BY cls HAVING count(*) >= 10 OR cls = 'all'")
def f19_promiscuity(spark, sf_dir):
    classes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("cls"))
    return X.promiscuity_summary(acro(spark, sf_dir), classes)


@query("""WITH r AS (SELECT l_linenumber <= 2 AS live, l_linenumber = 5 AS rdna, CAST(l_extendedprice AS DOUBLE) AS period, CAST(l_tax AS DOUBLE) * 10 AS strength FROM lineitem)
SELECT round(p, 1) AS live_period, round(round(p, 1) / 170.8, 2) AS live_monomers, live_periodic, rdna_period FROM (SELECT median(period) FILTER (WHERE live AND strength > 0.3) AS p, round(count(*) FILTER (WHERE live AND strength > 0.3) / greatest(count(*) FILTER (WHERE live), 1), 3) AS live_periodic, round(median(period) FILTER (WHERE rdna AND strength > 0.3), 1) AS rdna_period FROM r)""")
def f14_period_summary(spark, sf_dir):
    n = F.col("l_linenumber")
    return O.period_summary(read(spark, sf_dir, "lineitem").select((n <= 2).alias("live"), (n == 5).alias("rdna"), F.col("l_extendedprice").cast("double").alias("period"), (F.col("l_tax").cast("double") * 10).alias("strength")))


@query(f"""{SQL_COVER}, w AS (SELECT chrom, bin, sum(frac) FILTER (WHERE grp = 7) AS t, sum(frac) FILTER (WHERE grp IN (1, 2)) AS a, sum(frac) FILTER (WHERE grp = 1) AS g1, sum(frac) FILTER (WHERE grp = 2) AS g2 FROM cov GROUP BY chrom, bin)
SELECT chrom, bin, coalesce(t, 0) > 0 AS telo, round(least(coalesce(a, 0), 1), 6) AS rm_total, round(least(coalesce(g1, 0), 1), 6) AS rm_1, round(least(coalesce(g2, 0), 1), 6) AS rm_2 FROM dim LEFT JOIN w USING (chrom, bin)""")
def f12_flags(spark, sf_dir):
    rows = track(spark, sf_dir)
    got = I.flags(shares(spark, sf_dir), dimension(rows)[1], 7, [1, 2])
    return got.withColumns({c: F.round(c, 6) for c in ("rm_total", "rm_1", "rm_2")})


@query(f"""{SQL_COVER}, n AS (SELECT chrom, bin // 4 AS parent, count(*) AS n FROM dim GROUP BY ALL), m AS (SELECT chrom, bin // 4 AS parent, grp, sum(frac) / any_value(n) AS frac FROM cov JOIN n ON n.chrom = cov.chrom AND n.parent = cov.bin // 4 GROUP BY cov.chrom, cov.bin // 4, grp)
SELECT chrom, parent, CASE WHEN frac >= 0.3 THEN CAST(grp AS VARCHAR) ELSE '' END AS label, round(frac, 6) AS frac FROM (SELECT *, row_number() OVER (PARTITION BY chrom, parent ORDER BY frac DESC, array_position([3, 1, 2, 5, 4, 7, 6], grp)) AS r FROM m) WHERE r = 1""".replace("SELECT chrom, bin // 4 AS parent, grp, sum", "SELECT cov.chrom, cov.bin // 4 AS parent, grp, sum"))
def f32_parent_class(spark, sf_dir):
    rows = track(spark, sf_dir)
    return I.parent_class(shares(spark, sf_dir), dimension(rows)[1], 4, [3, 1, 2, 5, 4, 7, 6]).withColumn("frac", F.round("frac", 6))


_SQL_PARENT = "r AS (SELECT source AS parent, CASE WHEN lang = 'en' AND doc_id % 3 > 0 THEN -1 ELSE doc_id % 4 END AS child FROM documents)"


@query(f"""WITH {_SQL_PARENT} SELECT p.parent, coalesce(m.child, -1) AS child FROM (SELECT DISTINCT parent FROM r) p LEFT JOIN (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY count(*) DESC, child) AS i FROM r WHERE child >= 0 GROUP BY parent, child) m ON m.parent = p.parent AND m.i = 1""")
def f31_parent_majority(spark, sf_dir):
    child = F.when((F.col("lang") == "en") & (F.col("doc_id") % 3 > 0), -1).otherwise(F.col("doc_id") % 4)
    return E.parent_majority(read(spark, sf_dir, "documents").select(F.col("source").alias("parent"), child.alias("child")))


@query(f"WITH {SQL_CLUSTERS} SELECT round(count(*) FILTER (WHERE cluster >= 0 AND chrom <> 3) / greatest(count(*), 1), 6) AS recovered FROM rows WHERE cls IN ('en', 'de')")
def f16_recovered(spark, sf_dir):
    rows = clustered(spark, sf_dir).withColumn("cluster", F.when(F.col("chrom") == 3, -1).otherwise(F.col("cluster")))
    return E.recovered(rows, ["en", "de"]).withColumn("recovered", F.round("recovered", 6))


@query(f"""WITH {SQL_CLUSTERS}, more AS (SELECT CAST(replace(source, 'src', '') AS BIGINT) AS cluster, sum(length(text)) / 1e6 AS mb, avg((doc_id % 10) / 10) AS sd, avg((doc_id % 100) / 100) AS private FROM documents GROUP BY 1)
SELECT cluster, n_bins, round(mb, 6) AS mb, round(sd, 6) AS sd, round(private, 6) AS private, CASE WHEN dom_class <> 'fr' AND dom_class_frac >= 0.4 THEN dom_class WHEN sd >= 0.4 THEN 'segdup' ELSE printf('euchromatin %.0f%% GC', gc * 100) END || ' · ' || CASE WHEN dom_chrom_frac >= 0.8 THEN CAST(dom_chrom AS VARCHAR) ELSE n_chroms || ' chroms' END AS name FROM tab JOIN more USING (cluster)""")
def c25_cluster_names(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.regexp_replace("source", "src", "").cast("long").alias("cluster"), F.col("lang").alias("cls"), (F.col("doc_id") % 7).alias("chrom"), (F.char_length("text") / 10000).alias("gc"), F.char_length("text").alias("bp"), (F.col("doc_id") % 10 / 10).alias("sd"), (F.col("doc_id") % 100 / 100).alias("private"))
    table = E.cluster_table(rows)
    cls = F.when(F.col("dom_class") == "fr", "non_sat").otherwise(F.col("dom_class"))
    name = L.cluster_name(cls, F.col("dom_class_frac"), F.col("sd"), F.col("gc"), F.col("dom_chrom").cast("string"), F.col("dom_chrom_frac"), F.col("n_chroms"))
    return table.select("cluster", "n_bins", F.round("mb", 6).alias("mb"), F.round("sd", 6).alias("sd"), F.round("private", 6).alias("private"), name.alias("name"))


@query(f"{SQL_TRIAGE} SELECT contig, CASE WHEN tau >= 0.85 THEN 'collinear' WHEN tau <= -0.85 THEN 'inverted' WHEN abs(tau) >= 0.5 THEN 'mostly ordered' ELSE 'scrambled' END AS verdict, printf('%s:%.1f–%.1f Mb', CAST(contig AS VARCHAR), n_win * 0.1, (n_win + 1) * 0.1) AS label FROM triage WHERE tau IS NOT NULL")
def c27_order_verdict(spark, sf_dir):
    rows = C.triage(scan(spark, sf_dir), places(spark), BIN_BP).where("tau is not null")
    return rows.select("contig", L.order_verdict(F.col("tau")).alias("verdict"), L.span_label(F.col("contig"), F.col("n_win"), BIN_BP).alias("label"))


@query("""WITH e AS (SELECT least(min(p_size), min(p_partkey)) AS lo, greatest(max(p_size), max(p_partkey)) AS hi FROM part)
SELECT p_partkey, CAST(round_even((p_size - lo) / greatest(hi - lo, 1e-12) * 65535, 0) AS BIGINT) AS q_size, CAST(round_even((p_partkey - lo) / greatest(hi - lo, 1e-12) * 65535, 0) AS BIGINT) AS q_key, CAST(floor(least(cbrt(least(p_size / 60, 1)) * 255, 255)) AS BIGINT) AS heat FROM part, e""")
def c23_shared_frame(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_partkey").alias("key"))
    a, b = D.shared_frame([(rows.select("p_partkey", "p_size"), "p_size"), (rows.select("p_partkey", "key"), "key")])
    return a.join(b, "p_partkey").select("p_partkey", F.col("q_p_size").alias("q_size"), "q_key", D.stretched(F.col("p_size") / 60).alias("heat"))


@query(f"WITH {SQL_SCAN} SELECT contig, w, round(cover, 6) AS cover FROM (SELECT *, count(*) OVER () AS n FROM scan WHERE contig = 7 AND w BETWEEN 2 AND 40) WHERE n >= 8")
def k15_contig_walk(spark, sf_dir):
    return P.contig_walk(scan(spark, sf_dir), 7, 2, 40).select("contig", "w", F.round("cover", 6).alias("cover"))


@query(f"WITH {SQL_SCAN} SELECT contig, count(*) AS n_win FROM scan GROUP BY contig HAVING count(*) >= 5")
def d16_supported(spark, sf_dir):
    return X.supported(scan(spark, sf_dir), "contig", 5).groupBy("contig").agg(F.count("*").alias("n_win"))


@query("SELECT l_suppkey AS key, row_number() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), l_suppkey) - 1 AS place FROM lineitem GROUP BY l_suppkey")
def g11_first_seen(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return O.first_seen(rows, "key", "at")


@query("SELECT a, b FROM (SELECT l_orderkey AS a, l_linenumber AS b FROM lineitem) ORDER BY md5(a || ':' || b) LIMIT 500")
def h6_sampled_pairs(spark, sf_dir):
    """The sampling operator of pairs; its bound is the feature."""
    return E.sampled_pairs(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")), 500)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def i4_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return C.upsert(old, old.where("o_orderkey % 5 = 0").withColumn("status", F.lit("new")), "o_orderkey")


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def e6_attributes(spark, sf_dir):
    """Attributes joined by the explicit bin id, never by position."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


# Reads: orders; their alignments: line items. The middle of a place gives its bin.
_SQL_READS = f"""reads AS (SELECT o_orderkey AS read, 50000 + o_custkey % 1000 * 10 AS len, o_orderkey * 7 % 500 AS our_bin, o_orderkey * 7 % 500 // {PER_CHROM} AS our_chrom, (o_orderkey % 90 + 10) / 100 AS our_j, (o_custkey % 40) / 100 AS our_alt_j, 0.5 + (o_custkey % 50) / 100 AS our_cover FROM orders),
al AS (SELECT l_orderkey AS read, (l_orderkey * 7 + l_linenumber // 4) % 600 // {PER_CHROM} AS chrom, (l_orderkey * 7 + l_linenumber // 4) % 600 % {PER_CHROM} * {BIN_BP} + 20000 AS s, (l_orderkey * 7 + l_linenumber // 4) % 600 % {PER_CHROM} * {BIN_BP} + 80000 AS e, l_partkey % 61 AS mapq, CAST(l_quantity AS BIGINT) AS mlen, CAST(l_quantity AS BIGINT) + l_suppkey % 9 AS blen, l_linenumber <= 2 AS prim FROM lineitem),
best AS (SELECT read, chrom AS mm_chrom, chrom * {PER_CHROM} + (s + e) // 2 // {BIN_BP} AS mm_bin, mapq AS mm_mapq, mlen / greatest(blen, 1) AS mm_ident FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY mlen DESC, chrom, s, mapq DESC, blen) AS r FROM al WHERE prim) WHERE r = 1 AND chrom < 10),
j AS (SELECT reads.*, best.* EXCLUDE (read), mm_bin % {PER_CHROM} >= 40 AS mm_sat, 1 - pow(our_cover, 1.0 / 21) AS our_err, our_j / greatest(our_alt_j, 0.0001) AS margin, mm_bin IS NOT NULL AS aligned, coalesce(mm_bin IS NOT NULL AND mm_mapq >= 50 AND mm_bin % {PER_CHROM} < 40, false) AS conf, our_chrom = mm_chrom AS same FROM reads LEFT JOIN best USING (read))"""


def compared(spark, sf_dir):
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    key, spot = F.col("o_orderkey"), (F.col("l_orderkey") * 7 + F.expr("l_linenumber div 4")) % 600
    reads = o.select(key.alias("read"), (50_000 + F.col("o_custkey") % 1000 * 10).alias("len"), (key * 7 % 500).alias("our_bin"), F.floor(key * 7 % 500 / PER_CHROM).alias("our_chrom"), ((key % 90 + 10) / 100).alias("our_j"), (F.col("o_custkey") % 40 / 100).alias("our_alt_j"), (0.5 + F.col("o_custkey") % 50 / 100).alias("our_cover"))
    start = spot % PER_CHROM * BIN_BP + 20_000
    al = line.select(F.col("l_orderkey").alias("read"), F.floor(spot / PER_CHROM).alias("chrom"), start.alias("start"), (start + 60_000).alias("end"), (F.col("l_partkey") % 61).alias("mapq"), F.col("l_quantity").cast("long").alias("mlen"), (F.col("l_quantity").cast("long") + F.col("l_suppkey") % 9).alias("blen"), (F.col("l_linenumber") <= 2).alias("is_primary"))
    first = spark.range(10).select(F.col("id").alias("chrom"), (F.col("id") * PER_CHROM).alias("bin0"))
    return R.joined(reads, R.best_alignment(al, first, BIN_BP), places(spark), 21)


@query(f"""WITH {_SQL_READS} SELECT count(*) AS n_reads, round(median(len), 4) AS read_len_median, round(median(mm_ident) FILTER (WHERE aligned), 4) AS mm_identity_median, count(*) FILTER (WHERE conf) AS n_confident,
  round(avg(CAST(same AS INT)) FILTER (WHERE conf), 4) AS chrom, round(avg(CAST(abs(our_bin - mm_bin) <= 1 AS INT)) FILTER (WHERE conf), 4) AS bin_pm1, count(*) FILTER (WHERE mm_sat) AS n_satellite, round(avg(CAST(mm_mapq >= 20 AS INT)) FILTER (WHERE mm_sat), 3) AS mm_conf_frac, round(avg(CAST(same AS INT)) FILTER (WHERE mm_sat), 3) AS sat_chrom,
  count(*) FILTER (WHERE NOT aligned) AS unaligned, round(median(margin) FILTER (WHERE conf AND same), 2) AS correct_margin_median, round(max(margin) FILTER (WHERE conf AND NOT same), 3) AS worst_discordant_margin, round(avg(CAST(margin < 2 AS INT)) FILTER (WHERE conf), 4) AS abstain_frac, round(avg(CAST(same AS INT)) FILTER (WHERE conf AND margin >= 2), 4) AS kept_chrom FROM j""")
def k22_read_concordance(spark, sf_dir):
    return R.concordance(compared(spark, sf_dir))


@query(f"""WITH {_SQL_READS}, r AS (SELECT 1 - mm_ident AS x, our_err AS y FROM j WHERE aligned), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r)
SELECT round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM k""")
def f28_error_meter(spark, sf_dir):
    return R.error_meter(compared(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("pearson", "spearman", "slope", "intercept")})


@query(f"WITH {SQL_SCAN} SELECT contig, w, round(cover, 6) AS cover, array_to_string(ehits, ',') AS ehits FROM scan")
def b10_scan_sink(spark, sf_dir):
    """A scan with its lists, written and read again."""
    path = new_folder(spark, "sink")
    rows = scan(spark, sf_dir).withColumn("hits", F.col("ehits")).withColumn("sims", F.col("ejacc"))
    files.write_result({"rows": rows}, path, "scan")
    return files.read_result(spark, path, "scan")["rows"].select("contig", "w", F.round("cover", 6).alias("cover"), F.array_join(F.transform("ehits", lambda x: x.cast("string")), ",").alias("ehits"))


@query(f"{SQL_TRIAGE} SELECT contig, n_win, orient, jumps FROM triage")
def b12_triage_sink(spark, sf_dir):
    """Triage rows as text and JSON, read from the text and checked against the JSON."""
    path, rows = new_folder(spark, "sink"), C.triage(scan(spark, sf_dir), places(spark), BIN_BP)
    files.write_triage(rows, path)
    text = files.read_table(spark, path, schema=rows.schema).select("contig", "n_win", "orient", "jumps")
    return text.join(files.read_json(spark, path, rows.schema).select("contig", "n_win"), ["contig", "n_win"], "left_semi")


@query("SELECT source AS id, count(*) AS n, list_sort(list(DISTINCT lang))[1] AS first FROM documents GROUP BY source")
def b11_json_sink(spark, sf_dir):
    """Nested rows as JSON, published twice and read again."""
    path = new_folder(spark, "sink")
    rows = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("langs"))
    for part in (rows.limit(1), rows):
        files.write_json(part, path)
    return files.read_json(spark, path, rows.schema).select("id", "n", F.get("langs", F.lit(0)).alias("first"))


@query(f"WITH store AS ({SQL_STORE}) SELECT contig, count(*) AS hashes, CAST(sum(n) AS BIGINT) AS hits FROM store GROUP BY contig")
def b1_store_sink(spark, sf_dir):
    """The store of the documents with its bins, published over an older one and read under its parameters."""
    path, params = new_folder(spark, "sink"), Params(k=KMER, base_scaled=SCALED, bin_bp=BIN)
    whole, dim = doc_store(spark, sf_dir), K.bins(contigs(spark, sf_dir), BIN)
    for sketch in (whole.limit(10), whole):
        files.write_store(sketch, dim, path, params)
    return files.read_store(spark, path, params)[0].groupBy("contig").agg(F.count("*").alias("hashes"), F.sum("n").alias("hits"))


@query("SELECT 'documents' AS stage, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'labels', 'rows', CAST(count(*) AS DOUBLE) FROM labels")
def b7_metrics_sink(spark, sf_dir):
    """Metrics of two stages; writing one again leaves the other."""
    path = new_folder(spark, "sink")
    for table in ("labels", "documents", "documents"):
        files.write_metrics(read(spark, sf_dir, table).agg(F.lit("rows").alias("name"), F.count("*").cast("double").alias("value")), path, table)
    return files.read_metrics(spark, path)


_SQL_SUPPORT = " UNION ALL ".join(f"SELECT '{name}' AS rule, CAST(label AS VARCHAR) AS label, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY label) AS m FROM ({rows})) WHERE m >= {least} GROUP BY label" for name, least, rows in (("chromosome", X.SUPPORT["chromosome"], "SELECT c_nationkey AS label FROM customer WHERE c_custkey % 9 = 0"), ("family", X.SUPPORT["family"], "SELECT source AS label FROM documents WHERE source IS NOT NULL"), ("class", X.SUPPORT["class"], "SELECT p_size AS label FROM part")))
_SQL_GUARDS = " UNION ALL ".join(f"SELECT '{name}', 'all', n FROM (SELECT count(*) AS n FROM supplier) WHERE n >= {least}" for name, least in X.LEAST_ROWS.items())


@query(f"{_SQL_SUPPORT} UNION ALL {_SQL_GUARDS}")
def d15_class_support(spark, sf_dir):
    """Rows that are left for each measure: of labels with support, and of tables with rows enough."""
    rows = {
        "chromosome": read(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.col("c_nationkey").alias("label")),
        "family": read(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("label")),
        "class": read(spark, sf_dir, "part").select(F.col("p_size").alias("label")),
    }
    out = [X.supported(df, "label", X.SUPPORT[rule]).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col("label").cast("string").alias("label"), "n") for rule, df in rows.items()]
    whole = [X.guarded(read(spark, sf_dir, "supplier"), least).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), F.lit("all").alias("label"), "n") for rule, least in X.LEAST_ROWS.items()]
    return reduce(DataFrame.union, out + whole)


_SQL_AB = f"""WITH store AS MATERIALIZED (SELECT contig, h, count(*) AS n FROM ({sql_hits(21, "benchmark", "item_id", (1 << 60) // 5)}) GROUP BY ALL), nb AS (SELECT count(DISTINCT contig) AS n_bins FROM store), df AS (SELECT h, count(*) AS df FROM store GROUP BY h),
raw AS (SELECT contig, h, ln(1 + n) * ln(1 + n_bins / df) AS w FROM store JOIN df USING (h), nb WHERE df >= 2), x AS (SELECT contig, h, w / sqrt(sum(w * w) OVER (PARTITION BY contig)) AS w FROM raw),
size AS (SELECT contig, count(*) AS m FROM store GROUP BY contig), j AS (SELECT a.contig AS a, b.contig AS b, count(*) AS i FROM store a JOIN store b ON a.h = b.h AND a.contig < b.contig GROUP BY ALL), c AS (SELECT a.contig AS a, b.contig AS b, sum(a.w * b.w) AS cosine FROM x a JOIN x b ON a.h = b.h AND a.contig < b.contig GROUP BY ALL),
p AS (SELECT j.a, j.b, round(1 - i / (sa.m + sb.m - i), 9) AS d_jacc, round(1 - coalesce(cosine, 0), 9) AS d_cos FROM j LEFT JOIN c ON c.a = j.a AND c.b = j.b JOIN size sa ON sa.contig = j.a JOIN size sb ON sb.contig = j.b),
k AS (SELECT *, rank() OVER (ORDER BY d_jacc) + (count(*) OVER (PARTITION BY d_jacc) - 1) / 2 AS rj, rank() OVER (ORDER BY d_cos) + (count(*) OVER (PARTITION BY d_cos) - 1) / 2 AS rc, row_number() OVER (ORDER BY d_jacc, a, b) AS oj, row_number() OVER (ORDER BY d_cos, a, b) AS oc, count(*) OVER () AS n FROM p)
SELECT count(*) AS n, round(corr(rj, rc), 5) AS spearman, round(avg(CASE WHEN oc <= greatest(1, ceil(n * 0.2)) THEN 1 ELSE 0 END) FILTER (WHERE oj <= greatest(1, ceil(n * 0.1))), 5) AS recall FROM k"""


@query(_SQL_AB)
def k25_agreement(spark, sf_dir):
    """Pairs of passages that share words: exact Jaccard against the cosine of weighted words."""
    sketch = K.parents(K.store(K.portable_hits(contigs(spark, sf_dir, "benchmark", "item_id"), 21, 5), 200), 1 << 30)
    n = sketch.select("contig").distinct().count()
    x = K.tfidf(sketch, F.lit(n)).select(F.col("contig").alias("row"), "h", "w")
    pairs = K.pairs(sketch, 21).select(F.col("contig_a").alias("a"), F.col("contig_b").alias("b"), F.round(1 - F.col("jacc"), 9).alias("d_jacc"))
    both = pairs.join(gram(x).where("a < b"), ["a", "b"], "left").select("a", "b", "d_jacc", F.round(1 - F.coalesce("g", F.lit(0.0)), 9).alias("d_cos"))
    return E.agreement(both, "d_jacc", "d_cos", 0.1, 0.2).select("n", F.round("spearman", 5).alias("spearman"), F.round("recall", 5).alias("recall"))
