"""Projection, benchmarks, comparison and labs on toy data."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import sequence as S
from sketchloom.operators import cluster as C
from sketchloom.operators import compare as R
from sketchloom.operators import display as D
from sketchloom.operators import linear as A
from sketchloom.operators import mixing as X
from sketchloom.operators import ordered as O
from sketchloom.operators import project as P
from sketchloom.operators import simulate as M
from sketchloom.operators import sketch as K

STORE = "bin bigint, h bigint, n bigint"


def brute(query, store, v, idf, zn, k=8):
    """One query's projection by hand."""
    by = {}
    for b, h, _ in store:
        by.setdefault(b, set()).add(h)
    own = set(query)
    jacc = sorted(((len(own & s) / max(len(s) + len(own) - len(own & s), 1), b) for b, s in by.items()), key=lambda x: (-x[0], x[1]))[:k]
    shared = [h for h in query if h in v]
    hits = []
    if len(shared) >= 5:
        w = np.array([math.log1p(query[h]) * idf[h] for h in shared])
        z = (w / np.linalg.norm(w)) @ np.array([v[h] for h in shared])
        z /= max(np.linalg.norm(z), 1e-9)
        hits = sorted(((round(float(np.dot(z, q)), 9), b) for b, q in zn.items()), key=lambda x: (-x[0], x[1]))[:k]
    known = {h for s in by.values() for h in s}
    return len(own & known) / len(own), [b for _, b in hits], [round(s, 4) for s, _ in hits], [b for _, b in jacc], [round(j, 4) for j, _ in jacc]


def test_projection_by_hand(spark):
    rng = np.random.default_rng(1)
    store = sorted({(int(b), int(h)) for b in range(12) for h in rng.integers(0, 150, 30)})
    store = [(b, h, int(rng.integers(1, 4))) for b, h in store]
    df = Counter(h for _, h, _ in store)
    idf = {h: math.log1p(12 / d) for h, d in df.items() if d >= 2}
    z = {b: rng.normal(size=4) for b in range(12)}
    sigma = [4.0, 3.0, 2.0, 1.0]
    raw = {(b, h): math.log1p(n) * idf[h] for b, h, n in store if h in idf}
    norm = {b: math.sqrt(sum(w * w for (c, _), w in raw.items() if c == b)) for b in range(12)}
    v = {h: sum(w / norm[b] * z[b] for (b, g), w in raw.items() if g == h) / np.array(sigma) ** 2 for h in idf}
    zn = {b: x / np.linalg.norm(x) for b, x in z.items()}
    queries = {q: {int(h): int(rng.integers(1, 3)) for h in rng.integers(0, 250, 25)} for q in range(6)}
    queries[6] = {int(h): 1 for h in range(1000, 1020)}  # knows nothing: no model hits, fillers only
    queries[7] = {1: 3, 2: 3}  # under 10 occurrences: no window
    sketch = spark.createDataFrame(store, STORE)
    x = K.tfidf(sketch.select(F.lit(0).alias("contig"), "bin", "h", "n"), F.lit(12)).select("bin", "h", "w")
    vv, zz = P.model(x, spark.createDataFrame(list(idf.items()), "h bigint, idf double"), spark.createDataFrame([(b, [float(y) for y in q]) for b, q in z.items()], "bin bigint, z array<double>"), sigma)
    rows = [(q, h, n) for q, own in queries.items() for h, n in own.items()]
    got = {r["query"]: r for r in P.project(spark.createDataFrame(rows, "query bigint, h bigint, n bigint"), sketch, vv, zz, 4).collect()}
    assert set(got) == set(range(7)) and got[6]["hits"] == [] and got[6]["ehits"] == list(range(8)) and got[6]["ejacc"] == [0.0] * 8
    for q in range(7):
        cover, hits, sims, ehits, ejacc = brute(queries[q], store, v, idf, zn)
        r = got[q]
        assert r["cover"] == pytest.approx(cover) and r["hits"] == hits and r["sims"] == pytest.approx(sims, abs=2e-4) and r["ehits"] == ehits and r["ejacc"] == pytest.approx(ejacc, abs=2e-4)


def test_window_rules(spark):
    rng = np.random.default_rng(2)
    seq = "".join(rng.choice(list("ACGT"), 470))
    df = spark.createDataFrame([("c", seq)], "contig string, seq string")
    cut, whole = ({(r["w"], r["h"]) for r in P.scan_hits(df, 100, 21, 2, c).collect()} for c in (True, False))
    assert cut < whole and {w for w, _ in whole} == {0, 1, 2, 3}  # the last window is not complete
    by_hand = {(w, int(h)) for w in range(4) for h in S.portable_hashes(S.canonical_codes(S.encode(seq[100 * w : 100 * w + 100].encode()), 21)[1], 21) if h <= (1 << 60) // 2}
    assert cut == by_hand
    moved = {(r["w"], r["h"]) for r in P.scan_hits(df, 100, 21, 2, True, 50).collect()}
    assert moved == {(w, h) for w, h in {(w, int(h)) for w in range(4) for h in S.portable_hashes(S.canonical_codes(S.encode(seq[50 + 100 * w : 150 + 100 * w].encode()), 21)[1], 21) if h <= (1 << 60) // 2}}


def test_window_entries_fall_back(spark):
    scan = spark.createDataFrame([("c", 3, 0.98765, [], [], [10, 11, 40], [0.5, 0.4, 0.2]), ("c", 4, 1.0, [7], [0.9], [10], [0.5])], "contig string, w bigint, cover double, hits array<bigint>, sims array<double>, ehits array<bigint>, ejacc array<double>")
    places = spark.createDataFrame([(b, "chr1", b * 100, b * 100 + 100) for b in range(50)], "bin bigint, chrom string, start bigint, end bigint")
    got = {r["w"]: r for r in P.window_entries(scan, places, 100_000).collect()}
    assert got[3]["label"] == "c:0.3–0.4 Mb" and got[3]["cover"] == 0.988 and [tuple(h) for h in got[3]["hits"]] == [(10, 0.5), (11, 0.4), (40, 0.2)]
    assert [tuple(h) for h in got[4]["hits"]] == [(7, 0.9)] and [tuple(x)[:2] for x in got[4]["loci"]] == [("chr1", 1000)]


def test_benchmark_of_made_contigs(spark):
    rng = np.random.default_rng(3)
    docs = [(c, "".join(rng.choice(list("ACGT"), 6000))) for c in range(4)]
    seqs = spark.createDataFrame(docs, "contig bigint, seq string")
    bins = K.bins(seqs, 200).select("contig", "bin", (F.col("contig") == 0).alias("sat"))
    own = M.spans(bins, 6, 8)
    assert {(r["stratum"], r["contig"] == 0) for r in own.collect()} == {("sat", True), ("eu", False)}
    cut = M.corrupted(own, seqs, 6, 200, 8, S.reverse_complement)
    text = dict(docs)
    spots = {(r["stratum"], r["i"]): r for r in own.collect()}
    for r in cut.collect():
        s = spots[r["stratum"], r["i"]]
        whole = text[s["contig"]][s["b"] * 200 + 100 :][:1200]
        assert len(r["seq"]) == 1200
        if r["kind"] == "control":
            assert r["seq"] == whole
        elif r["kind"] == "inversion":
            assert r["seq"] == whole[:400] + whole[400:800][::-1].translate(str.maketrans("ACGT", "TGCA")) + whole[800:]
        else:
            assert r["seq"][:600] == whole[:600] and r["seq"][600:] != whole[600:]
    placed = spark.createDataFrame([(k, w, 0, float(m), 0.5) for k, own in {"fine": range(7), "turned": [0, 1, 5, 4, 3, 2, 6]}.items() for w, m in enumerate(own)], "contig string, w bigint, chrom bigint, mb double, j double")
    got = {r["contig"]: r for r in M.order_rows(placed, 4).collect()}
    assert got["fine"]["tau"] == 1 and got["fine"]["min_tau"] == 1 and got["turned"]["min_tau"] == -1 and got["fine"]["jumps"] == 0


def test_long_tau_equals_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(0, 40, n) / 100]) for i, n in enumerate([0, 1, 2, 3, 17, 64, 65, 200, 300])]
    got = {r["i"]: r for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", O.long_tau(F.col("v")).alias("a"), O.tau_a(F.col("v")).alias("b")).collect()}
    for i, v in rows:
        want = sum(np.sign(b - a) if abs(b - a) > 0.01 else 0 for k, a in enumerate(v) for b in v[k + 1 :]) / max(len(v) * (len(v) - 1) / 2, 1)
        assert got[i]["a"] == pytest.approx(want) and got[i]["b"] == pytest.approx(want)


def test_error_rate(spark):
    reads = spark.createDataFrame([(i, "ACGTN" * 400) for i in range(10)], "id bigint, seq string")
    for rate in (0.0, 0.05):
        got = M.with_errors(reads, rate).collect()
        off = [sum(a != b for a, b in zip(r["seq"], "ACGTN" * 400)) / 1600 for r in got]
        assert np.mean(off) == pytest.approx(rate, abs=0.01) and all(r["seq"][4::5] == "N" * 400 for r in got)
        assert {r["id"]: r["seq"] for r in M.with_errors(reads.repartition(3), rate).collect()} == {r["id"]: r["seq"] for r in got}


def test_read_comparison(spark):
    al = [("a", 1, 0, 200, 60, 90, 100, True), ("a", 2, 0, 200, 60, 95, 100, False), ("a", 0, 0, 200, 60, 80, 100, True), ("b", 9, 0, 200, 60, 90, 100, True)]
    al = spark.createDataFrame(al, "read string, chrom bigint, start bigint, end bigint, mapq bigint, mlen bigint, blen bigint, is_primary boolean")
    first = spark.createDataFrame([(0, 0), (1, 10)], "chrom bigint, bin0 bigint")
    best = R.best_alignment(al, first, 100)
    assert [tuple(r)[:3] for r in best.collect()] == [("a", 1, 11)]
    reads = spark.createDataFrame([("a", 50_000, 11, 1, 0.6, 0.2, 1.0), ("b", 60_000, 3, 0, 0.5, 0.4, 0.9)], "read string, len bigint, our_bin bigint, our_chrom bigint, our_j double, our_alt_j double, our_cover double")
    places = spark.createDataFrame([(b, False) for b in range(20)], "bin bigint, sat boolean")
    one = R.concordance(R.joined(reads, best, places, 21)).first()
    assert (one["n_reads"], one["n_confident"], one["chrom"], one["bin_pm1"], one["unaligned"], one["abstain_frac"], one["sat_chrom"]) == (2, 1, 1.0, 1.0, 1, 0.0, None)


def test_mixing_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4) + 6 * np.eye(4)[i % 2]], i % 2, i // 2 * 100) for i in range(60)]
    got = X.promiscuity(spark.createDataFrame(rows, "id bigint, z array<double>, chrom bigint, pos bigint"), 5, 5, 50).collect()
    assert len(got) == 60 and np.mean([r["promiscuity"] for r in got]) < 0.1 and np.mean([r["vote"] == r["chrom"] for r in got]) > 0.95
    assert X.promiscuity(spark.createDataFrame(rows[:40], "id bigint, z array<double>, chrom bigint, pos bigint")).count() == 0


def test_svd_of_low_rank_and_empty(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12))
    rows = [(i, j, float(x[i, j])) for i in range(40) for j in range(12)]
    z, sigma = A.subspace_svd(spark.createDataFrame(rows, "row bigint, h bigint, w double"), 6)
    assert len(sigma) <= 6 and sigma[:3] == pytest.approx(np.linalg.svd(x)[1][:3], rel=1e-6) and (sigma[3:] < 1e-4).all()
    z = np.array([r["z"] for r in sorted(z.collect())])
    assert np.allclose(z @ z.T, x @ x.T, atol=1e-6)
    assert len(A.subspace_svd(spark.createDataFrame([], "row bigint, h bigint, w double"), 3)[1]) == 0


def test_linkage_equals_plain():
    rng = np.random.default_rng(6)
    d = C.distances(rng.integers(0, 6, (40, 3)).astype(float))  # many ties
    got = C.average_linkage(d)
    groups, heights = {i: [i] for i in range(40)}, []
    for a, b, h, n in got:
        left, right = groups.pop(int(a)), groups.pop(int(b))
        mean = np.mean([d[x, y] for x in left for y in right])
        others = [np.mean([d[x, y] for x in p for y in q]) for i, p in groups.items() for j, q in groups.items() if i < j]
        assert h == pytest.approx(mean) and all(h <= o + 1e-9 for o in others) and n == len(left) + len(right)
        groups[40 + len(heights)] = left + right
        heights.append(h)
    with pytest.raises(ValueError):
        C.distances(np.zeros((C.MOST_POINTS + 1, 1)))


def test_lanes_and_sweep(spark):
    rows = [("c", 1, 0.0, 10.0), ("c", 2, 18.0, 20.0), ("c", 3, 18.5, 19.0), ("c", 4, 40.0, 41.0)]
    got = {r["id"]: r["lane"] for r in D.lanes(spark.createDataFrame(rows, "chrom string, id bigint, lo double, hi double")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}  # just 8 apart is too near
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(40, 2)) + 20 * c for c in range(3)])
    settings, pairs = D.sweep(C.distances(x), [(10, 5), (20, 5), (20, 10)])
    assert [s[2] for s in settings] == [3, 3, 3] and all(p[4] == pytest.approx(1) for p in pairs) and [p[5] for p in pairs] == [True, False, True]
