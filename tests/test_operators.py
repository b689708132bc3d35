import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import labels as L
from sketchloom.operators import cluster as C
from sketchloom.operators import evaluate as E
from sketchloom.operators import intervals as I
from sketchloom.operators import linear as A
from sketchloom.operators import neighbours as N
from sketchloom.operators import ordered as O
from sketchloom.operators import scans as X


def test_names(spark):
    names = {"hor_1_5(S1C1/5/19H1L)": "asat_hor_live", "hor_9_2(S4C9H2)": "asat_hor", "dhor_22_1(S2C22H2_d)": "asat_dhor", "mon_13_1(mixedAlp)": "asat_mon", "ct_1_1(p_arm)": "ct", "censat_1_1(rnd-6_family-4384)": "other_sat", "hsat1A_13_2": "hsat1A", "rDNA_13_1": "rDNA", "hsat3_X_1(x)": "hsat3", "mystery_1_1(z)": ""}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", L.satellite_class(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == names


def test_coverage_merge_arms(spark):
    dim = spark.createDataFrame([("c1", 0, 0, 100), ("c1", 1, 100, 200), ("c2", 0, 0, 100)], "chrom string, bin bigint, start bigint, end bigint")
    iv = spark.createDataFrame([("c1", 10, 20, "a"), ("c1", 90, 120, "a"), ("c2", 0, 100, "b"), ("cX", 0, 50, "a")], "chrom string, start bigint, end bigint, grp string")
    lengths = spark.createDataFrame([("c1", 200), ("c2", 100)], "chrom string, length bigint")
    assert sorted(map(tuple, I.coverage(iv, dim, 100, lengths).collect())) == [("c1", 0, "a", 0.2), ("c1", 1, "a", 0.2), ("c2", 0, "b", 1.0)]
    iv = spark.createDataFrame([("c", 0, 5), ("c", 5, 8), ("c", 1, 3), ("c", 9, 10)], "chrom string, start bigint, end bigint")
    assert sorted(map(tuple, I.merged(iv).collect())) == [("c", 0, 8), ("c", 9, 10)]


def test_periods(spark):
    rng = np.random.default_rng(0)
    rows = [("c", int(u + 2000 * i), int(h)) for h, u in enumerate(rng.integers(0, 2000, 30)) for i in range(40)]
    rows += [("r", int(p), int(h)) for h, p in zip(rng.integers(0, 900, 3000), rng.integers(0, 100_000, 3000))]
    got = {r["contig"]: r for r in O.periods(spark.createDataFrame(rows, "contig string, pos bigint, h bigint"), 100_000).collect()}
    assert got["c"]["period"] == pytest.approx(2000, rel=0.05) and got["c"]["strength"] > 0.6
    assert "r" not in got or got["r"]["strength"] < 0.3


def test_loci(spark):
    rows = [(1, "chrY", 60, 61, 0.9), (1, "chrY", 62, 63, 0.85), (1, "chr1", 10, 11, 0.8), (1, "chrY", 61, 62, 0.7), (1, "chrY", 63, 64, 0.65), (2, "chrY", 60, 61, 0.5), (2, "chrY", 75, 76, 0.4)]
    got = O.loci(spark.createDataFrame(rows, "query int, chrom string, start bigint, end bigint, score double"), 3).orderBy("query", "rank").collect()
    assert [(r["query"], r["chrom"], r["n"], r["sim"]) for r in got] == [(1, "chrY", 4, 0.9), (1, "chr1", 1, 0.8), (2, "chrY", 1, 0.5), (2, "chrY", 1, 0.4)]


PLACES = [(b, b // 50, (b % 50) * 0.1 + 0.05, b >= 80) for b in range(100)]


def scan_of(spark, rows):
    data = [(c, w, cover, [top] + [top] * 7, [j] * 8) for c, w, cover, top, j in rows]
    return spark.createDataFrame(data, "contig string, w bigint, cover double, ehits array<bigint>, ejacc array<double>")


def places_of(spark):
    return spark.createDataFrame(PLACES, "bin bigint, chrom bigint, mb double, sat boolean")


def test_triage(spark):
    rows = [("fwd", w, 0.99, 10 + w, 0.8) for w in range(10)] + [("rev", w, 0.99, 40 - w, 0.8) for w in range(10)]
    rows += [("jump", w, 0.99, 10 + w if w < 6 else 60 + w, 0.8) for w in range(9)]
    rows += [("nov", w, 0.5 if 4 <= w <= 8 else 0.99, 85 + w % 3, 0.8) for w in range(12)]
    rows += [("gap", w, 0.5, 5, 0.8) for w in [0, 1, 2, 3, 4, 6, 7, 8, 9]] + [("un", w, 0.99, 5, 0.01) for w in range(8)] + [("tiny", w, 0.99, 5, 0.8) for w in range(2)]
    scan = scan_of(spark, rows)
    got = {r["contig"]: r for r in X.triage(scan, places_of(spark), 100_000).collect()}
    assert set(got) == {"fwd", "rev", "jump", "nov", "gap", "un"}
    assert (got["fwd"]["tau"], got["fwd"]["orient"], got["rev"]["tau"], got["rev"]["orient"]) == (1.0, "forward", -1.0, "reverse")
    assert (got["jump"]["dom_chrom"], got["jump"]["jumps"], got["jump"]["end5"]) == (0, 1, "non-sat")
    n = got["nov"]
    assert (n["novel_run_mb0"], n["novel_run_mb1"], n["novel_run_mincov"], n["end5"], n["end3"]) == (0.4, 0.9, 0.5, "satellite", "satellite")
    assert (got["gap"]["novel_run_mb0"], got["gap"]["novel_run_mb1"]) == (0.0, 0.5)
    assert got["un"]["orient"] == "unplaced" and got["un"]["tau"] is None and got["un"]["dom_chrom"] == -1
    one = X.summary(X.triage(scan, places_of(spark), 100_000), scan, 100, 100_000).first()
    assert one["n_windows"] == len(rows) and one["n_forward"] == 2 and one["n_unplaced"] == 1


def test_picker_and_thinning(spark):
    rows = [("wide", i, 0.9, 50 + 2 * i, 0.5) for i in range(16)] + [("dense", i, 0.9, 55 + i % 6, 0.5) for i in range(20)] + [("next", i, 0.9, 60 + i, 0.5) for i in range(15)] + [("two", i, 0.9, 60, 0.5) for i in range(2)]
    scan = scan_of(spark, rows)
    assert {r["contig"] for r in X.whole_chromosome(scan, 50, 99, 100_000, 120).collect()} == {"wide"}
    gone = spark.createDataFrame([("wide",)], "contig string")
    assert {r["contig"] for r in X.whole_chromosome(scan, 50, 99, 100_000, 120, exclude=gone).collect()} == {"next"}
    tig = scan_of(spark, [("t", i, 0.9, 50 + i // 2, 0.5) for i in range(40)])
    got = sorted((r["w"], r["n_all"]) for r in X.whole_chromosome(tig, 50, 99, 100_000, 10).collect())
    assert len(got) == 10 and got[0] == (0, 40) and got[-1] == (39, 40)


def test_order_statistics(spark):
    tau = lambda v: spark.createDataFrame([(v,)], "v array<double>").select(O.tau_a(F.col("v"))).first()[0]
    up = [i * 0.1 for i in range(20)]
    assert tau(up) == 1.0 and tau(up[::-1]) == -1.0 and tau([1.0]) == 0.0 and tau([1.0, 1.005]) == 0.0
    mixed = up[:7] + up[7:14][::-1] + up[14:]
    w = spark.createDataFrame([("c", i, 0, m) for i, m in enumerate(mixed)], "contig string, w int, chrom int, mb double")
    assert O.local_tau(w).first()["min_tau"] == -1.0
    sw = spark.createDataFrame([("c", i, i // 10, m) for i, m in enumerate(up)], "contig string, w int, chrom int, mb double")
    assert O.jumps(sw).first()["jumps"] == 1


def test_auc_ari_ami(spark):
    rows = lambda neg, pos: spark.createDataFrame([(float(x), False) for x in neg] + [(float(x), True) for x in pos], "s double, p boolean")
    assert E.auc(rows([0] * 10, [1] * 10), "s", "p").first()[0] == 1.0
    assert E.auc(rows(range(5), range(5)), "s", "p").first()[0] == 0.5
    assert E.auc(rows([0, 1], [1, 2]), "s", "p").first()[0] == 0.875
    same = spark.createDataFrame([(i % 3, (i % 3) + 5) for i in range(30)], "a int, b int")
    assert E.adjusted_rand(same, "a", "b").first()[0] == 1.0
    assert E.adjusted_mutual_information(same, "a", "b") == pytest.approx(1.0)
    free = spark.createDataFrame([(i % 3, i // 10) for i in range(30)], "a int, b int")
    assert abs(E.adjusted_mutual_information(free, "a", "b")) < 0.15


def test_knn_vote(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, z[i].tolist(), i % 4, i // 4, i % 3) for i in range(60)], "id bigint, z array<double>, chrom bigint, pos bigint, label int")
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    s = u @ u.T
    for i in range(60):
        for j in range(60):
            if i % 4 == j % 4 and abs(i // 4 - j // 4) <= 2:
                s[i, j] = -np.inf
    got = {(r["id"], r["rank"]): r["other"] for r in N.knn(df, 4, apart=2).collect()}
    assert all(got[i, r + 1] == np.argsort(-s[i], kind="stable")[r] for i in range(60) for r in range(4))
    assert N.vote(N.knn(df, 4, apart=2), df.select("id", "label")).count() == 60


def test_svd_fold_in_procrustes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 80))
    x[:30] += 3
    rows = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(80)], "row bigint, h bigint, w double")
    z, sigma = A.subspace_svd(rows, 5, rounds=7)
    assert np.allclose(sigma, np.linalg.svd(x, compute_uv=False)[:5], rtol=1e-3)
    one = A.folded_in(rows.where("row = 3").withColumnRenamed("row", "query"), rows, z, sigma).first()["z"]
    own = np.array(z.where("row = 3").first()["z"])
    assert np.dot(one, own / np.linalg.norm(own)) == pytest.approx(1, abs=1e-3)
    p = rng.normal(size=(50, 2))
    t = np.array([[0.6, -0.8], [0.8, 0.6]])
    pts = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, 2 * p @ t)], "x double, y double, tx double, ty double")
    turn, scale = A.procrustes(pts)
    assert np.allclose(turn, t) and scale == pytest.approx(2)


def test_clustering():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [rng.uniform(-20, 20, (5, 2))])
    labels, prob = C.hdbscan(C.distances(x), 10, 5)
    assert [len(set(labels[a : a + 40]) - {-1}) for a in (0, 40, 80)] == [1, 1, 1] and len(set(labels[:120]) - {-1}) == 3
    assert ((prob >= 0) & (prob <= 1)).all()
    line = np.array([[0.0], [1.0], [10.0], [11.5]])
    links = C.average_linkage(C.distances(line))
    assert links[0].tolist() == [0, 1, 1.0, 2] and links[2][2] == pytest.approx(10.25)
    order = C.leaf_order(links, C.distances(line)).tolist()
    assert order in ([0, 1, 2, 3], [3, 2, 1, 0])
    y = C.umap(x[:120], neighbours=10, rounds=60)
    assert y.shape == (120, 2) and np.isfinite(y).all()
