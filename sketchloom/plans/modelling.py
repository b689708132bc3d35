"""Queries of decompositions, clusterings, layouts, labs and simulated benchmarks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import cluster as C
from ..operators import layout as U
from ..operators import linear as L
from ..operators import simulate as M
from ..operators import sketch as K
from ..operators import display as D
from ..operators import neighbours as N
from ..operators import project as P
from ..operators import trees as T
from ..operators.evaluate import best_setting, dot, unit, whitened
from ..session import written
from .base import KMER, SCALED, contigs, query, read, sql_hits, sql_seqs, texts
from .projecting import sql_found


def points(spark, sf_dir):
    """(id, z) of the embeddings."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))


def long_rows(spark, sf_dir):
    """The embeddings as rows (row, h, w) of a matrix."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("h", "w")).withColumn("w", F.col("w").cast("double"))


_WIDTH = 64
_SQL_LONG = "x AS (SELECT vec_id AS row, unnest(range(0, len(embedding))) AS h, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings)"


@query()
def j2_svd_sigma(spark, sf_dir):
    _, sigma = L.subspace_svd(long_rows(spark, sf_dir), 16)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "dim int, sigma double")


@query(f"""WITH {_SQL_LONG}, g AS (SELECT a.h, b.h AS k, sum(a.w * b.w) AS g FROM x a JOIN x b ON a.row = b.row GROUP BY a.h, b.h)
SELECT (SELECT round(sum(w * w), 4) FROM x) AS squares, (SELECT round(sum(g * g), 2) FROM g) AS fourths""")
def j2_svd_moments(spark, sf_dir):
    """All singular values by their sums of squares and of fourth powers: the norms of the matrix and of its Gram matrix."""
    _, sigma = L.subspace_svd(long_rows(spark, sf_dir), _WIDTH)
    return spark.createDataFrame([(round(float((sigma**2).sum()), 4), round(float((sigma**4).sum()), 2))], "squares double, fourths double")


@query("SELECT vec_id AS query, 1.0 AS cosine FROM embeddings")
def j3_fold_in(spark, sf_dir):
    """Rows folded in as queries find their own coordinates: at full rank the cosine is 1."""
    x = long_rows(spark, sf_dir)
    z, sigma = L.subspace_svd(x, _WIDTH)
    got = L.folded_in(x.withColumnRenamed("row", "query"), x, z, sigma)
    return got.join(z.select(F.col("row").alias("query"), unit(F.col("z")).alias("own")), "query").select("query", F.round(dot(F.col("z"), F.col("own")), 6).alias("cosine"))


@query()
def j7_hdbscan(spark, sf_dir):
    ids, ((labels, prob),) = T.hdbscan(points(spark, sf_dir), [(10, 5)])
    return spark.createDataFrame([(int(i), int(a), float(p)) for i, a, p in zip(ids, labels, prob)], "vec_id bigint, cluster int, prob double")


@query()
def j10_linkage(spark, sf_dir):
    return spark.createDataFrame([(s, int(a), int(b), float(d), int(n)) for s, (a, b, d, n) in enumerate(T.linkage(points(spark, sf_dir)))], "step int, left bigint, right bigint, dist double, size bigint")


_SQL_TURN = """p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS tx, CAST(embedding[4] AS DOUBLE) AS ty FROM embeddings),
m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(tx) AS mtx, avg(ty) AS mty FROM p), c AS (SELECT sum((x - mx) * (tx - mtx)) AS a, sum((x - mx) * (ty - mty)) AS b, sum((y - my) * (tx - mtx)) AS c, sum((y - my) * (ty - mty)) AS d, sum((x - mx) ** 2 + (y - my) ** 2) AS n FROM p, m),
s AS (SELECT *, sqrt((a + d) ** 2 + (b - c) ** 2) AS s1, sqrt((a - d) ** 2 + (b + c) ** 2) AS s2 FROM c),
q AS (SELECT CASE WHEN a * d >= b * c THEN (a + d) / s1 ELSE (a - d) / s2 END AS q11, CASE WHEN a * d >= b * c THEN (b - c) / s1 ELSE (b + c) / s2 END AS q12, CASE WHEN a * d >= b * c THEN (c - b) / s1 ELSE (b + c) / s2 END AS q21, CASE WHEN a * d >= b * c THEN (a + d) / s1 ELSE (d - a) / s2 END AS q22, greatest(s1, s2) / n AS scale FROM s)"""


@query(f"WITH {_SQL_TURN} SELECT vec_id, round(scale * ((x - mx) * q11 + (y - my) * q21) + mtx, 5) AS ax, round(scale * ((x - mx) * q12 + (y - my) * q22) + mty, 5) AS ay FROM p, m, q")
def j11_procrustes(spark, sf_dir):
    """The first two components of the embeddings, moved, scaled and turned onto the next two."""
    e = F.col("embedding")
    points = read(spark, sf_dir, "embeddings").select("vec_id", *[F.get(e, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x", "y", "tx", "ty"))])
    return L.aligned(points).select("vec_id", F.round("ax", 5).alias("ax"), F.round("ay", 5).alias("ay"))


@query()
def j6_umap(spark, sf_dir):
    found = U.graph(points(spark, sf_dir))
    y = U.umap(found, rounds=50)
    return spark.createDataFrame(pa.table({"vec_id": found[0], "x": y[:, 0], "y": y[:, 1]}))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings) SELECT (SELECT count(*) - 1 FROM v) AS merges, (SELECT count(*) FROM v) AS last_size,
  (SELECT round(min(list_distance(a.z, b.z)), 5) FROM v a JOIN v b ON a.vec_id < b.vec_id) AS first_dist""")
def j10_linkage_ends(spark, sf_dir):
    """What any linkage of all points must give: one merge less than points, the nearest pair first, all points last."""
    links = T.linkage(points(spark, sf_dir))
    return spark.createDataFrame([(len(links), int(links[-1, 3]), round(float(links[0, 2]), 5))], "merges bigint, last_size bigint, first_dist double")


def passage_distances(spark, sf_dir):
    """(names, d) of benchmark passages by 1 - cANI: few bins, so the driver may hold their distances."""
    sketch = K.parents(K.store(K.portable_hits(contigs(spark, sf_dir, "benchmark", "item_id"), KMER, 5), 200), 1 << 30)
    C.guard(sketch.select("contig").distinct().count())
    rows = K.distances(K.pairs(sketch, KMER), sketch).collect()
    names = sorted({r["a"]["contig"] for r in rows})
    at, d = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]["contig"]], at[r["b"]["contig"]]] = r["d_ani"]
    return names, d


@query()
def j8_hdbscan_cani(spark, sf_dir):
    names, d = passage_distances(spark, sf_dir)
    labels, prob = C.hdbscan(d, 5, 3)
    return spark.createDataFrame([(n, int(a), float(p)) for n, a, p in zip(names, labels, prob)], "item bigint, cluster int, prob double")


@query()
def j9_umap_cani(spark, sf_dir):
    names, d = passage_distances(spark, sf_dir)
    xy = C.umap(d, neighbours=15, min_dist=0.1, precomputed=True)
    order = C.leaf_order(C.average_linkage(d), d) if len(d) > 1 else np.arange(len(d))
    place = {int(i): r for r, i in enumerate(order)}
    return spark.createDataFrame([(n, float(x), float(y), place[i]) for i, (n, (x, y)) in enumerate(zip(names, xy))], "item bigint, x double, y double, leaf int")


KS = (15, 17, 19, 21, 23, 25)
_SQL_LADDER = " UNION ALL ".join(f"SELECT {k} AS k, CAST(sum(df) AS BIGINT) AS n_kept, count(*) AS n_distinct, count(*) FILTER (WHERE df >= 2) AS n_shared FROM (SELECT h, count(DISTINCT contig) AS df FROM ({sql_hits(k)}) GROUP BY h)" for k in KS)


@query(_SQL_LADDER)
def j12_k_ladder(spark, sf_dir):
    """One plan over word lengths: kept hashes by document, different ones, and those of two documents or more."""
    docs, out = contigs(spark, sf_dir), None
    for k in KS:
        df = K.document_frequency(K.portable_hits(docs, k, SCALED).select("contig", "h").distinct())
        one = df.agg(F.lit(k).alias("k"), F.sum("df").alias("n_kept"), F.count("*").alias("n_distinct"), F.count_if(F.col("df") >= 2).alias("n_shared"))
        out = one if out is None else out.union(one)
    return out


def blocks_of(spark, sf_dir, many: int):
    """The embeddings as `many` vocabularies: equal parts of their components, each at unit length."""
    z, size = F.col("embedding").cast("array<double>"), _WIDTH // many
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get(z, F.lit(0)).alias("gc"), *[unit(F.slice(z, i * size + 1, size)).alias(f"b{i}") for i in range(many)])


@query()
def j13_structure_lab(spark, sf_dir):
    """Whitening by four strengths, and the best one whose class accuracy stays within 0.02 of none."""
    rows, results = blocks_of(spark, sf_dir, 1), []
    sigma = [1 + 0.1 * i for i in range(_WIDTH)]
    for alpha in (0.0, 0.35, 0.7, 1.0):
        v = rows.select("id", "label", "gc", whitened(F.col("b0"), sigma, alpha).alias("z"))
        results.append((f"a{int(alpha * 100):03d}", float(D.knn_accuracy(v).first()["accuracy"]), float(D.knn_r2(v, "gc").first()["r2"])))
    return best_setting(spark.createDataFrame(results, "tag string, health double, score double"), "a000")


@query()
def j14_multi_vocabulary(spark, sf_dir):
    """Candidate sets of vocabularies side by side: class accuracy and regression of each."""
    rows, results = blocks_of(spark, sf_dir, 4), []
    for name, own in (("first two", (0, 1)), ("ends", (0, 3)), ("first, third", (0, 2)), ("three", (0, 1, 3)), ("all", (0, 1, 2, 3))):
        v = rows.select("id", "label", "gc", F.concat(*[f"b{i}" for i in own]).alias("z"))
        results.append((name, float(D.knn_accuracy(v).first()["accuracy"]), float(D.knn_r2(v, "gc").first()["r2"])))
    return spark.createDataFrame(results, "vocabularies string, accuracy double, r2 double")


@query("""WITH r AS (SELECT o_orderpriority AS tag, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS health, round(avg(o_totalprice), 6) AS score FROM orders GROUP BY 1), b AS (SELECT health FROM r WHERE tag = '1-URGENT')
SELECT tag, r.health, score, r.health >= b.health - 0.02 AS able, row_number() OVER (PARTITION BY r.health >= b.health - 0.02 ORDER BY score DESC, tag) = 1 AND r.health >= b.health - 0.02 AS best FROM r, b""")
def j13_selection(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("health"), F.round(F.avg("o_totalprice"), 6).alias("score"))
    return best_setting(rows, "1-URGENT")


@query()
def k24_stability(spark, sf_dir):
    """How far neighbours stay: layouts of other seeds, and sketches of documents at 2 and 4 times the scale."""
    found = U.graph(points(spark, sf_dir))
    layout = lambda seed: spark.createDataFrame(pa.table({"id": found[0], "y": U.umap(found, rounds=50, seed=seed).tolist()})).select("id", F.col("y").alias("z"))
    base, out = written(N.knn(layout(42), 15, "euclidean"), "near"), []
    for seed in (1, 2, 3):
        out.append((f"seed {seed}", float(N.overlap(base, N.knn(layout(seed), 15, "euclidean"), 15).agg(F.avg("jaccard")).first()[0])))
    store = written(K.parents(K.text_store(texts(spark, sf_dir), KMER, 20, 200, portable=True), 1 << 30), "store")

    def near(times: int):
        sketch = K.downsampled(store, (1 << S.PORTABLE_BITS) // (20 * times))
        n = sketch.select("contig").distinct().count()
        rows = K.tfidf(sketch, F.lit(n)).select(F.col("contig").alias("row"), "h", "w")
        z, _ = L.subspace_svd(rows, 8, rounds=3)
        return N.knn(z.select(F.col("row").cast("bigint").alias("id"), "z"), 5)

    whole = near(1)
    return spark.createDataFrame(out + [(f"scale x {t}", float(N.overlap(whole, near(t), 5).agg(F.coalesce(F.avg("jaccard"), F.lit(0.0))).first()[0])) for t in (2, 4)], "change string, overlap double")


_P, _WIN, _SPAN, _SCALE, _SHIFT = 21, 200, 6, 5, 1 << 20


def reference(spark, sf_dir):
    """(docs, store, dim) of the documents: bins (bin, contig, sat); a third of the documents counts as satellite."""
    docs = contigs(spark, sf_dir)
    sketch = written(K.store(K.portable_hits(docs, _P, _SCALE), _WIN).select((F.col("contig") * _SHIFT + F.col("bin")).alias("bin"), "h", "n"), "store")
    dim = K.bins(docs, _WIN).select("contig", "bin", (F.col("contig") % 3 == 0).alias("sat"))
    return docs, sketch, dim


def placed_windows(found, sketch):
    """Windows (contig, w, h, n) with their best bin: (contig, w, chrom, mb, j, cover)."""
    sizes = sketch.groupBy("bin").agg(F.count("*").alias("size"))
    got = P.exact(written(P.enough(found.select(F.struct("contig", "w").alias("query"), "h", "n")), "windows"), sketch, sizes, [], 1).where(F.size("ehits") > 0)
    top = F.get("ehits", F.lit(0))
    return got.select("query.contig", "query.w", top.alias("top"), F.expr(f"ehits[0] div {_SHIFT}").alias("chrom"), ((top % _SHIFT) * _WIN + _WIN / 2).alias("mb"), F.get("ejacc", F.lit(0)).alias("j"), "cover")


def fragments(spark, sf_dir, many: int):
    docs, sketch, dim = reference(spark, sf_dir)
    own = M.spans(dim, _SPAN, many)
    cut = M.corrupted(written(own, "spans"), docs, _SPAN, _WIN, 20, S.reverse_complement).select("stratum", "i", "kind", F.concat_ws("/", "stratum", F.col("i").cast("string"), "kind").alias("contig"), "seq")
    cut = written(cut, "fragments")
    found = P.scan_hits(cut.select("contig", "seq"), _WIN, _P, _SCALE, True)
    rows = placed_windows(found, sketch)
    return cut.select("contig", "stratum", "i", "kind").join(M.order_rows(rows.withColumn("mb", F.col("mb") / _WIN), 4), "contig").drop("contig")


def _sql_spans(most: int) -> str:
    """(stratum, i, contig, b) of the sampled spans; docs is a CTE."""
    return f"""SELECT * FROM (SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(contig || ':' || b)) - 1 AS i, contig, b FROM (
  SELECT contig, b, CASE WHEN share >= 0.6 THEN 'sat' WHEN share = 0 THEN 'eu' END AS stratum FROM (
    SELECT contig, b, avg(CASE WHEN contig % 3 = 0 THEN 1 ELSE 0 END) OVER o AS share, count(*) OVER o AS n FROM (SELECT contig, unnest(range(0, (length(seq) - 1) // {_WIN} + 1)) AS b FROM docs WHERE length(seq) > 0) WINDOW o AS (PARTITION BY contig ORDER BY b ROWS BETWEEN CURRENT ROW AND {most} FOLLOWING)
  ) WHERE n = {most + 1}) WHERE stratum IS NOT NULL) WHERE i < 40"""


_SQL_REF = f"""WITH docs AS MATERIALIZED ({sql_seqs()}), store AS MATERIALIZED (SELECT contig * {_SHIFT} + pos // {_WIN} AS bin, h, count(*) AS n FROM ({sql_hits(_P, keep=(1 << 60) // _SCALE, seqs="SELECT * FROM docs")}) GROUP BY ALL),
size AS (SELECT bin, count(*) AS sb FROM store GROUP BY bin)"""
#: From found (contig, w, h, n): each window's best bin, as placed_windows().
_SQL_PLACED = f"""q AS MATERIALIZED (SELECT contig, w, h FROM (SELECT *, sum(n) OVER (PARTITION BY contig, w) AS many FROM found) WHERE many >= 10), sq AS (SELECT contig, w, count(*) AS sq FROM q GROUP BY contig, w),
inter AS (SELECT contig, w, bin, count(*) AS i FROM q JOIN store USING (h) GROUP BY ALL), best AS (SELECT contig, w, bin, round(j, 4) AS j FROM (SELECT contig, w, bin, j, row_number() OVER (PARTITION BY contig, w ORDER BY j DESC, bin) AS r FROM (SELECT contig, w, bin, i / greatest(sb + sq - i, 1) AS j FROM inter JOIN sq USING (contig, w) JOIN size USING (bin))) WHERE r = 1),
cov AS (SELECT contig, w, avg(CASE WHEN k.h IS NULL THEN 0 ELSE 1 END) AS cover FROM q LEFT JOIN (SELECT DISTINCT h FROM store) k USING (h) GROUP BY contig, w),
placed AS MATERIALIZED (SELECT contig, w, bin AS top, bin // {_SHIFT} AS chrom, bin % {_SHIFT} + 0.5 AS mb, j, cover FROM best JOIN cov USING (contig, w))"""
_SIZE, _HALF, _A, _B = _SPAN * _WIN, _SPAN // 2 * _WIN, _SPAN // 3 * _WIN, 2 * _SPAN // 3 * _WIN
_SQL_FRAGMENTS = f"""{_SQL_REF}, own AS MATERIALIZED ({_sql_spans(_SPAN)}), cuts AS MATERIALIZED (SELECT stratum, i, own.contig, b, substr(seq, b * {_WIN} + {_WIN // 2} + 1, {_SIZE}) AS seq FROM own JOIN docs USING (contig)),
met AS (SELECT a.stratum, a.i, c.i AS j, c.contig <> a.contig AS far_contig, CASE WHEN abs(c.b - a.b) <= 20 THEN 1 ELSE 0 END AS near, CASE WHEN c.i > a.i THEN c.i ELSE c.i + 1000000 END AS turn FROM own a JOIN own c ON a.stratum = c.stratum AND a.i <> c.i),
partner AS (SELECT stratum, i, 'misjoin_inter' AS kind, arg_min(j, turn) AS j FROM met WHERE far_contig GROUP BY stratum, i UNION ALL SELECT stratum, i, 'misjoin_intra', j FROM (SELECT *, row_number() OVER (PARTITION BY stratum, i ORDER BY near, turn) AS r FROM met WHERE NOT far_contig) WHERE r = 1),
made AS (SELECT stratum, i, 'control' AS kind, seq FROM cuts UNION ALL SELECT stratum, i, 'inversion', substr(seq, 1, {_A}) || reverse(translate(substr(seq, {_A + 1}, {_B - _A}), 'ACGT', 'TGCA')) || substr(seq, {_B + 1}, {_SIZE - _B}) FROM cuts
  UNION ALL SELECT c.stratum, c.i, p.kind, substr(c.seq, 1, {_HALF}) || substr(d.seq, 1, {_SIZE - _HALF}) FROM cuts c JOIN partner p ON p.stratum = c.stratum AND p.i = c.i JOIN cuts d ON d.stratum = c.stratum AND d.i = p.j),
named AS MATERIALIZED (SELECT stratum || '/' || i || '/' || kind AS contig, stratum, i, kind, seq FROM made),
found AS MATERIALIZED ({sql_found("SELECT contig, seq FROM named", True)}), {_SQL_PLACED},
jumps AS (SELECT contig, count(*) FILTER (WHERE broken) AS jumps FROM (SELECT contig, lag(chrom) OVER o <> chrom OR abs(lag(mb) OVER o - mb) > 5 AS broken FROM placed WINDOW o AS (PARTITION BY contig ORDER BY w)) GROUP BY contig),
nth AS (SELECT contig, chrom, mb, row_number() OVER (PARTITION BY contig ORDER BY w) AS k FROM placed), met2 AS (SELECT a.contig, a.k AS ka, b.k AS kb, CASE WHEN abs(b.mb - a.mb) > 0.01 THEN sign(b.mb - a.mb) ELSE 0 END AS s FROM nth a JOIN nth b ON a.contig = b.contig AND a.k < b.k),
spans AS (SELECT n.contig, n.k, count(*) = 4 AND min(m.chrom) = max(m.chrom) AS able FROM nth n JOIN nth m ON m.contig = n.contig AND m.k BETWEEN n.k AND n.k + 3 GROUP BY n.contig, n.k),
slide AS (SELECT s.contig, s.k, sum(m.s) / 6 AS t FROM spans s JOIN met2 m ON m.contig = s.contig AND m.ka >= s.k AND m.kb <= s.k + 3 WHERE able GROUP BY s.contig, s.k),
fragments AS MATERIALIZED (SELECT n.stratum, n.i, n.kind, jumps, round(coalesce((SELECT min(t) FROM slide s WHERE s.contig = n.contig), 0), 3) AS min_tau, round(CASE WHEN many < 2 THEN 0 ELSE (SELECT sum(s) FROM met2 m WHERE m.contig = n.contig) / (many * (many - 1) / 2) END, 3) AS tau, j_med
  FROM named n JOIN jumps USING (contig) JOIN (SELECT contig, count(*) AS many, round(median(j), 3) AS j_med FROM placed GROUP BY contig) USING (contig))"""


@query(f"WITH docs AS ({sql_seqs()}) {_sql_spans(_SPAN)}")
def a11_span_sampler(spark, sf_dir):
    return M.spans(reference(spark, sf_dir)[2], _SPAN, 40)


@query(f"{_SQL_FRAGMENTS} SELECT * FROM fragments")
def k20_misassembly(spark, sf_dir):
    """Made contigs, whole and corrupted in three ways, by the order of their windows' placements (cells: f27_bench_cells)."""
    return fragments(spark, sf_dir, 40)


_SQL_TOLD = """e AS (SELECT stratum, k AS of, kind = k AS pos, CASE WHEN k = 'inversion' THEN (1 - min_tau) / 2 ELSE jumps END AS score, CASE WHEN k = 'inversion' THEN min_tau <= -0.7 ELSE jumps >= 1 END AS hit FROM r JOIN (VALUES ('inversion'), ('misjoin_inter'), ('misjoin_intra')) v(k) ON kind = k OR kind = 'control'),
a AS (SELECT *, rank() OVER (PARTITION BY stratum, of ORDER BY score) + (count(*) OVER (PARTITION BY stratum, of, score) - 1) / 2 AS rank FROM e)
SELECT stratum, of AS kind, round((sum(rank) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 3) AS auc, round(avg(CAST(hit AS INT)) FILTER (WHERE pos), 3) AS detected, round(avg(CAST(hit AS INT)) FILTER (WHERE NOT pos), 3) AS control_fpr FROM a GROUP BY stratum, of"""
_SQL_CELLS = f"""WITH r AS (SELECT o_orderstatus AS stratum, ['control', 'inversion', 'misjoin_inter', 'misjoin_intra'][o_orderkey % 4 + 1] AS kind, o_orderkey % 7 % 3 AS jumps, (o_custkey % 21) / 10.0 - 1 AS min_tau FROM orders), {_SQL_TOLD}"""


@query(f"{_SQL_FRAGMENTS}, r AS (SELECT * FROM fragments), {_SQL_TOLD}")
def k20_misassembly_cells(spark, sf_dir):
    return M.cells(fragments(spark, sf_dir, 40))


@query(_SQL_CELLS)
def f27_bench_cells(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(k) for k in M.KINDS]), (F.col("o_orderkey") % 4).cast("int"))
    return M.cells(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stratum"), kind.alias("kind"), (F.col("o_orderkey") % 7 % 3).alias("jumps"), (F.col("o_custkey") % 21 / 10.0 - 1).alias("min_tau")))


LENGTHS, RATES = (1, 2, 4), (0, 2, 5)
_SQL_STRAND = f"CASE WHEN {M.seed_sql('name')} % 2 = 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END"


@query(f"""{_SQL_REF}, own AS MATERIALIZED ({_sql_spans(max(LENGTHS))}), cell AS (SELECT n, e FROM (SELECT unnest({list(LENGTHS)}) AS n), (SELECT unnest({list(RATES)}) AS e)),
reads AS MATERIALIZED (SELECT stratum || '/' || i || '/' || n || '/' || e AS name, stratum, contig AS chrom0, b AS b0, n, e, substr(seq, b * {_WIN} + {_WIN // 2} + 1, n * {_WIN}) AS s FROM own JOIN docs USING (contig), cell),
noisy AS MATERIALIZED (SELECT name AS contig, {M.errors_sql("name", _SQL_STRAND, "(e / 100.0)")} AS seq FROM reads),
found AS MATERIALIZED (SELECT contig, 0 AS w, h, count(*) AS n FROM ({sql_hits(_P, keep=(1 << 60) // _SCALE, seqs="SELECT * FROM noisy")}) GROUP BY ALL), {_SQL_PLACED}
SELECT stratum, n * {_WIN} AS length, e / 100.0 AS err, count(*) AS n, round(avg(CASE WHEN chrom = chrom0 AND top % {_SHIFT} BETWEEN b0 AND b0 + n THEN 1 ELSE 0 END), 3) AS top1, round(avg(CASE WHEN chrom = chrom0 THEN 1 ELSE 0 END), 3) AS chrom_acc, round(median(j), 3) AS j_med, round(median(cover), 3) AS cover_med
FROM reads LEFT JOIN placed ON placed.contig = reads.name GROUP BY stratum, reads.n, e""")
def k21_reads(spark, sf_dir):
    """Reads of three lengths, three error rates and two strata, on either strand: placement, Jaccard and cover of each cell."""
    docs, sketch, dim = reference(spark, sf_dir)
    each = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    own = written(M.spans(dim, max(LENGTHS), 40), "spans").select("*", each(LENGTHS, "n")).select("*", each(RATES, "e"))
    reads = own.join(docs, "contig").select("stratum", F.col("contig").alias("chrom0"), F.col("b").alias("b0"), "n", "e", F.concat_ws("/", "stratum", F.col("i").cast("string"), F.col("n").cast("string"), F.col("e").cast("string")).alias("id"), F.expr(f"substring(seq, int(b * {_WIN} + {_WIN // 2 + 1}), n * {_WIN})").alias("seq"))
    reads = written(reads.withColumn("seq", F.when(M.seed_of(F.col("id")) % 2 == 0, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))), "reads")
    seqs = M.with_errors(reads.select("id", "seq", "e"), F.col("e") / 100.0).select(F.col("id").alias("contig"), "seq")
    found = K.store(K.portable_hits(seqs, _P, _SCALE), 1 << 30).withColumnRenamed("bin", "w")
    got = reads.drop("seq").withColumnRenamed("id", "contig").join(placed_windows(found, sketch), "contig", "left")
    share = lambda on: F.round(F.avg(F.coalesce(on.cast("int"), F.lit(0))), 3)
    home = F.col("chrom") == F.col("chrom0")
    cells = got.groupBy("stratum", "n", "e").agg(F.count("*").alias("many"), share(home & (F.col("top") % _SHIFT).between(F.col("b0"), F.col("b0") + F.col("n"))).alias("top1"), share(home).alias("chrom_acc"), F.round(F.median("j"), 3).alias("j_med"), F.round(F.median("cover"), 3).alias("cover_med"))
    return cells.select("stratum", (F.col("n") * _WIN).alias("length"), (F.col("e") / 100.0).alias("err"), F.col("many").alias("n"), "top1", "chrom_acc", "j_med", "cover_med")
