"""Operators that must hold at any size: products in tiles, order statistics by ranges, neighbours by descent."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import sequence as S
from sketchloom.operators import evaluate as E
from sketchloom.operators import neighbours as N
from sketchloom.operators import products as P
from sketchloom.operators import ranges as R
from sketchloom.operators import sketch as K


def entries(seed, rows=60, hashes=40, common=3):
    """(row, h, w) with some hashes in every row."""
    r = random.Random(seed)
    return [(i, h, r.choice([1.0, -0.5, 2.0])) for i in range(rows) for h in {*range(common), *(r.randint(common, hashes) for _ in range(r.randint(0, 6)))}]


def brute(a, b=None, diagonal=False):
    of = {}
    for i, h, w in b or a:
        of.setdefault(h, []).append((i, w))
    n, g = Counter(), Counter()
    for i, h, w in a:
        for j, v in of.get(h, []):
            if b is not None or i < j or diagonal and i == j:
                n[i, j] += 1
                g[i, j] += w * v
    return {k: (n[k], pytest.approx(g[k])) for k in n}


@pytest.mark.parametrize("rare, block", [(1, 7), (5, 16), (1000, 7), (None, 1024)])
def test_products(spark, monkeypatch, rare, block):
    monkeypatch.setattr(P, "BLOCK", block)
    a, b = entries(1), entries(2, 35)
    da, db = (spark.createDataFrame(x, "row bigint, h bigint, w double") for x in (a, b))
    got = lambda df: {(r["a"], r["b"]): (r["n"], r["g"]) for r in df.collect()}
    assert got(P.products(da, rare=rare)) == brute(a)
    assert got(P.products(da, diagonal=True, rare=rare)) == brute(a, diagonal=True)
    assert got(P.products(da, db, rare=rare)) == brute(a, b)
    named = db.withColumn("row", F.struct(F.lit('x"é').alias("c"), F.col("row").alias("i")))
    assert {(r["a"], r["b"]["i"]): (r["n"], r["g"]) for r in P.products(da, named, rare=rare).collect() if r["b"]["c"] == 'x"é'} == brute(a, b)


@pytest.mark.parametrize("joined, most", [(16, 2048), (0, 2048), (10**6, 8)])
def test_products_by_what_a_join_would_make(spark, monkeypatch, joined, most):
    """One hash in all rows: one join where it makes few pairs, tiles where it makes many or has too many rows."""
    monkeypatch.setattr(P, "JOINED", joined)
    monkeypatch.setattr(P, "MOST", most)
    monkeypatch.setattr(P, "RARE", 4)
    rows = [(r, h) for r in range(12) for h in (0, 100 + r // 2, *range(1000 + 9 * r, 1009 + 9 * r))]
    got = P.products(spark.createDataFrame(rows, "row bigint, h bigint"))
    assert {(x["a"], x["b"]): x["n"] for x in got.collect()} == {(a, b): 1 + (a // 2 == b // 2) for a in range(12) for b in range(a + 1, 12)}


def test_bins_of_texts(spark):
    """The kernel on bytes against the columns of bins(): empty, null and odd texts, letters of other alphabets."""
    texts = spark.createDataFrame([(1, "Hello, brave new world " * 30), (2, ""), (3, None), (4, "…é 12 "), (5, "abcdefghij"), (6, "ß" + "xyz" * 7)], "contig bigint, text string")
    squeezed = texts.where("text is not null").select("contig", S.squeezed(F.col("text")).alias("seq")).where("seq <> ''")
    assert sorted(map(tuple, K.text_bins(texts, 10).collect())) == sorted(map(tuple, K.bins(squeezed, 10).collect()))


def test_products_of_nothing(spark):
    none = spark.createDataFrame([], "row bigint, h bigint")
    assert P.products(none).count() == 0 and P.products(none, none).count() == 0


def test_one_hash_in_all_bins(spark, monkeypatch):
    """The join sees no common hash, and the pairs are right."""
    monkeypatch.setattr(P, "BLOCK", 100)
    store = spark.range(300).select((F.col("id") % 3).alias("contig"), F.col("id").alias("bin"), F.explode(F.array(F.lit(7).cast("long"), F.col("id") + 100)).alias("h"), F.lit(1).alias("n"))
    got = K.pairs(store, 21)
    assert got.count() == 300 * 299 // 2 and got.where("inter <> 1 or abs(jacc - 1 / 3) > 1e-12").count() == 0


def test_quantiles(spark):
    r = random.Random(3)
    values = [r.choice([0.0, 1.0, r.random(), 1e9, -5.5]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    shares = [0, 0.1, 0.25, 0.5, 0.77, 0.999, 1]
    assert R.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert R.median(df.where("v > 1e10"), "v") is None and R.median(df.where("v = 1"), "v") == 1


def test_numbers(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a bigint, b bigint").repartition(6)
    assert {(r["a"], r["b"]): r["_n"] for r in R.numbered(df, F.desc("a"), "b").collect()} == {k: n for n, k in enumerate(sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1])))}
    assert sorted(map(tuple, R.first_rows(df, 33, "a", "b").collect())) == sorted((i % 7, i) for i in range(500))[:33]
    counts = spark.createDataFrame([(1.5, 3), (2.0, 1), (9.0, 2)], "v double, n bigint")
    assert {r["v"]: r["rank"] for r in E.average_ranks(counts, "v").collect()} == {1.5: 2.0, 2.0: 4.0, 9.0: 5.5}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_descent(spark, metric):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    z = centres[rng.integers(0, 40, 2500)] + rng.normal(scale=0.4, size=(2500, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(z.tolist())], "id bigint, z array<double>").repartition(4)
    exact, found = ({(r["id"], r["other"]) for r in f(df, 10, metric).collect()} for f in (N.knn, N.nn_descent))
    assert len(exact & found) / len(exact) >= 0.95 and len(found) == len(exact)


def test_descent_keeps_apart_and_common_neighbours(spark):
    """A row that all others are nearest to is no hot group, and rows next to each other are no neighbours."""
    rng = np.random.default_rng(2)
    z = np.concatenate([np.ones((1, 8)), 1 + rng.normal(scale=0.9, size=(600, 8))])
    df = spark.createDataFrame([(i, v, i % 3, i // 3) for i, v in enumerate(z.tolist())], "id bigint, z array<double>, chrom bigint, pos bigint")
    found = N.neighbours(df, 5, apart=2, exact_rows=10).collect()
    exact = {(r["id"], r["other"]) for r in N.neighbours(df, 5, apart=2).collect()}
    assert all(r["id"] % 3 != r["other"] % 3 or abs(r["id"] // 3 - r["other"] // 3) > 2 for r in found)
    assert len({(r["id"], r["other"]) for r in found} & exact) / len(exact) >= 0.95


@pytest.mark.parametrize("block_rows, entries_of_tile", [(8192, 65_536), (20, 100)])
def test_svd_keeps_weak_directions(spark, monkeypatch, block_rows, entries_of_tile):
    """Singular values from 1 to 1e-9, of a matrix in one tile and in many."""
    from sketchloom.operators import linear as L

    monkeypatch.setattr(L, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(L, "ENTRIES", entries_of_tile)
    rng = np.random.default_rng(4)
    u, v = (np.linalg.qr(rng.normal(size=(n, 10)))[0] for n in (90, 50))
    sigma = 10.0 ** -np.arange(10)
    a = u * sigma @ v.T
    x = spark.createDataFrame([(f"r{i}", j, float(a[i, j])) for i in range(90) for j in range(50)], "row string, h bigint, w double").repartition(5)
    z, got = L.subspace_svd(x, 10, extra=2)
    assert got == pytest.approx(sigma, rel=1e-5)
    rows = {r["row"]: np.array(r["z"]) for r in z.collect()}
    zz = np.array([rows[f"r{i}"] for i in range(90)])
    assert np.abs(zz @ zz.T - a @ a.T).max() < 1e-12
    cut, got = L.subspace_svd(x, 3, extra=1)
    assert got == pytest.approx(sigma[:3], rel=1e-6)


def test_svd_of_less(spark):
    from sketchloom.operators import linear as L

    one = spark.createDataFrame([(1, 5, 2.0), (2, 5, 0.0), (1, 6, 0.0)], "row bigint, h bigint, w double")
    z, sigma = L.subspace_svd(one, 4)
    assert sigma[0] == pytest.approx(2) and {r["row"]: abs(r["z"][0]) for r in z.collect()} == {1: pytest.approx(2), 2: pytest.approx(0)}
    for rows in ([], [(1, 1, 0.0)]):
        z, sigma = L.subspace_svd(spark.createDataFrame(rows, "row bigint, h bigint, w double"), 4)
        assert len(sigma) == 0 and z.count() == len(rows)
