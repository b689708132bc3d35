"""What reviews found on larger tables, as small cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.operators import cluster as C
from sketchloom.operators import display as D
from sketchloom.operators import evaluate as E
from sketchloom.operators import layout as U
from sketchloom.operators import neighbours as N
from sketchloom.operators import simulate as M
from sketchloom.operators import trees as T
from sketchloom.plans import registry
from test_queries import rows_of


def table(spark, tmp_path, name, rows, schema):
    """A table of its own in a folder of its own."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def told(tmp_path, name, *tables):
    """What a query's SQL says of a folder's tables."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return rows_of(con.sql(registry.ORACLE_SQL[name]).df())


def test_tau_of_part_keys_above_a_million(spark, tmp_path):
    rows = [(1, 1, 1_150_000), (1, 2, 40), (1, 3, 2_000_000), (2, 1, 1_000_500), (2, 2, 500), (2, 3, 900), (3, 1, 1_000_007), (3, 2, 7), (4, 1, 5), (5, 1, 9), (5, 1, 9), (5, 2, 700)]
    at = table(spark, tmp_path, "lineitem", rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint")
    assert rows_of(registry.QUERIES["k4_kendall_tau"](spark, at).toPandas()) == told(tmp_path, "k4_kendall_tau", "lineitem")


def test_cells_without_a_kind(spark):
    rows = spark.createDataFrame([("eu", "control", 0, 1.0), ("eu", "inversion", 0, -1.0), ("sat", "misjoin_inter", 2, 0.0)], "stratum string, kind string, jumps bigint, min_tau double")
    got = {(r["stratum"], r["kind"]): r["auc"] for r in M.cells(rows).collect()}
    assert got == {("eu", "inversion"): 1.0, ("eu", "misjoin_inter"): None, ("eu", "misjoin_intra"): None, ("sat", "misjoin_inter"): None}


def test_correlation_of_what_does_not_vary(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    got = E.correlation(rows, "x", "y").first()
    assert math.isnan(got["pearson"]) and math.isnan(got["spearman"])
    assert E.correlation(rows.where("x > 1"), "x", "y").first()["pearson"] is None


def test_sweep_gives_plain_numbers(spark):
    rng = np.random.default_rng(2)
    d = C.distances(np.concatenate([rng.normal(c, 0.5, (30, 2)) for c in (0, 20, 40)]))
    settings, pairs = D.sweep(d, [(5, 3), (10, 3), (25, 10), (10, 10)])
    assert all(type(v) in (int, float, bool) for r in settings + pairs for v in r)


def points(spark, copies=0):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (60, 5)) for c in (0, 9, 30)] + [np.ones((copies, 5))])
    return x, spark.createDataFrame([(i * 3, [float(v) for v in z]) for i, z in enumerate(x)], "id bigint, z array<double>")


@pytest.mark.parametrize("copies", [0, 40])
def test_linkage_of_distributed_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(T, "block_count", lambda n, slots: 3)
    x, rows = points(spark, copies)
    got, want = T.linkage(rows, 12), C.average_linkage(C.distances(x))
    assert got.shape == want.shape and got[:, 2] == pytest.approx(want[:, 2], abs=1e-6)
    members = {i: frozenset([i]) for i in range(len(x))}
    for s, (a, b, _, n) in enumerate(got):
        members[len(x) + s] = members[int(a)] | members[int(b)]
        assert len(members[len(x) + s]) == n
    if not copies:
        assert got[:, :2].tolist() == want[:, :2].tolist()


@pytest.mark.parametrize("part", [16, 2048])
def test_spanning_tree_of_distributed_rows(spark, monkeypatch, part):
    monkeypatch.setattr(T, "PART", part)
    monkeypatch.setattr(T, "MERGED", 2)
    monkeypatch.setattr(T, "block_count", lambda n, slots: 4)
    x, rows = points(spark, 20)
    d = C.distances(x)
    got = T.spanning_edges(rows, 5)
    want = C.spanning_tree(d, np.sort(d, axis=1)[:, 4])
    assert len(got) == len(x) - 1 and got[:, 2] == pytest.approx(np.sort(want[:, 2]), abs=1e-6)
    edges = np.concatenate([got[:, :2] / 3, got[:, 2:]], axis=1)
    assert sorted(np.bincount(C.clusters_of_tree(edges, len(x), 10)[0] + 1)) == sorted(np.bincount(C.hdbscan(d, 10, 5)[0] + 1))


@pytest.mark.parametrize("name", ["j7_hdbscan", "j10_linkage", "k23_cluster_sweep", "k23_sweep_pairs"])
def test_trees_of_more_vectors_than_a_matrix_may_have(spark, sf, monkeypatch, name):
    monkeypatch.setattr(C, "MOST_POINTS", 400)
    monkeypatch.setattr(T, "LAST", 300)
    monkeypatch.setattr(T.linkage, "__defaults__", (300,))
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_umap_of_distributed_rows(spark):
    x, rows = points(spark)
    ids, start, i, j, p = U.graph(rows, 7)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    near, w = np.argsort(d, axis=1, kind="stable")[:, :7], np.zeros(d.shape)
    np.put_along_axis(w, near, C.memberships(np.maximum(np.take_along_axis(d, near, 1), 0)), 1)
    w = w + w.T - w * w.T
    got = np.zeros(d.shape)
    got[i, j] = p
    assert ids.tolist() == [3 * r for r in range(len(x))] and np.abs(got - np.triu(w, 1)).max() < 1e-4
    s = np.linalg.svd(u - u.mean(0), full_matrices=False)
    assert np.abs(start) == pytest.approx(np.abs(s[0][:, :2] * s[1][:2]), abs=1e-6)
    y = U.umap((ids, start, i, j, p), rounds=20)
    assert y.shape == (len(x), 2) and np.isfinite(y).all()


@pytest.mark.parametrize("name", ["j6_umap", "k24_stability"])
def test_layouts_of_more_vectors_than_a_matrix_may_have(spark, sf, monkeypatch, name):
    monkeypatch.setattr(C, "MOST_POINTS", 400)
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_descent_completed_by_all_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6))
    x[50:60] = x[0]
    rows = spark.createDataFrame([(i, [float(v) for v in z]) for i, z in enumerate(x)], "id bigint, z array<double>")
    poor = N.nn_descent(rows, 5, rounds=0).where("id % 20 = 0 and other % 3 > 0 and id <> 40")
    got = {(r["id"], r["rank"]): (r["other"], r["sim"]) for r in N.completed(poor.where("rank <= 5"), rows, rows.where("id % 20 = 0"), 5).collect()}
    con = duckdb.connect()
    con.execute("create table v (id bigint, z double[])")
    con.executemany("insert into v values (?, ?)", [(i, z.tolist()) for i, z in enumerate(x)])
    want = con.sql("select id, rank, other, sim from (select a.id, b.id as other, list_cosine_similarity(a.z, b.z) as sim, row_number() over (partition by a.id order by list_cosine_similarity(a.z, b.z) desc, b.id) as rank from v a join v b on a.id <> b.id where a.id % 20 = 0) where rank <= 5").fetchall()
    assert {(i, r): o for i, r, o, _ in want} == {k: v[0] for k, v in got.items()}


@pytest.mark.parametrize("margin", [0.0, 1.1, 8.0])
def test_first_lanes_equal_one_by_one(margin):
    rng = np.random.default_rng(4)
    lo = rng.integers(0, 120, 300) * 0.37
    hi = lo + rng.integers(0, 13, 300) * 0.37
    used, want = [], []
    for a, b in zip(lo, hi):
        lane = next((i for i, own in enumerate(used) if all(b + margin < x or a - margin > y for x, y in own)), len(used))
        used += [[]] if lane == len(used) else []
        used[lane].append((a, b))
        want.append(lane)
    assert D.first_lanes(lo, hi, margin).tolist() == want


def test_rows_go_to_few_blocks_and_ties_stay(spark):
    assert N.block_count(600_000, 6) <= 20 and N.block_count(51_282, 6) == 4 and N.block_count(10, 6) == 1
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 3)), 1)  # many equal distances
    got = N.knn(spark.createDataFrame([(i, [float(v) for v in z]) for i, z in enumerate(x)], "id bigint, z array<double>"), 4, "euclidean").collect()
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    same = sum(abs(d[r["id"], r["other"]] - d[r["id"], want[r["id"], r["rank"]]]) < 1e-8 for r in got)
    assert len(got) == same == len(want)
