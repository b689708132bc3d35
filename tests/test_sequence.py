import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.functions import sequence as S
from sketchloom.operators import sketch as K
from sketchloom.params import Params

M = S.MASK64


def murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 x64-128 in plain integers, low half."""
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & M
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    n = len(data)
    for i in range(0, n - n % 16, 16):
        k1, k2 = (int.from_bytes(data[i + j : i + j + 8], "little") for j in (0, 8))
        h1 ^= rot(k1 * c1 & M, 31) * c2 & M
        h1 = (((rot(h1, 27) + h2) & M) * 5 + 0x52DCE729) & M
        h2 ^= rot(k2 * c2 & M, 33) * c1 & M
        h2 = (((rot(h2, 31) + h1) & M) * 5 + 0x38495AB5) & M
    tail = data[n - n % 16 :]
    if len(tail) > 8:
        h2 ^= rot(int.from_bytes(tail[8:], "little") * c2 & M, 33) * c1 & M
    if tail:
        h1 ^= rot(int.from_bytes(tail[:8], "little") * c1 & M, 31) * c2 & M
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = (h1 + h2) & M
    h2 = (h2 + h1) & M

    def mix(x):
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & M
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & M
        return x ^ (x >> 33)

    return (mix(h1) + mix(h2)) & M


def words_in(data):
    """Little-endian numbers of the bytes of each row."""
    return lambda at, size: sum((data[:, at + j].astype(np.uint64) << np.uint64(8 * j) for j in range(size)), np.zeros(len(data), np.uint64))



@pytest.mark.parametrize("size", [1, 5, 8, 15, 16, 17, 21, 31, 32, 47])
def test_murmur_equals_plain_integers(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 256, (20, size)).astype(np.uint8)
    got = S.murmur3_low64(words_in(data), size, len(data), 42)
    assert [int(x) for x in got] == [murmur(bytes(d), 42) for d in data]


def test_published_vectors():
    for text, want in ((b"hello", 0xCBD8A7B341BD9B02), (b"The quick brown fox jumps over the lazy dog", 0xE34BBC7BBC071B6C)):
        assert int(S.murmur3_low64(words_in(np.frombuffer(text, np.uint8).reshape(1, -1)), len(text), 1, 0)[0]) == want


def test_max_hash():
    assert [S.max_hash(s) for s in (1, 2, 10, 1000)] == [18446744073709551615, 9223372036854775808, 1844674407370955264, 18446744073709552]


def plain_sketch(seq: str, k: int, scaled: int):
    out = []
    for i in range(len(seq) - k + 1):
        f = seq[i : i + k].upper()
        if set(f) <= set("ACGT"):
            c = min(f, f[::-1].translate(str.maketrans("ACGT", "TGCA")))
            h = murmur(c.encode(), 42)
            if h <= S.max_hash(scaled):
                out.append((i, h))
    return out


@settings(max_examples=25, deadline=None)
@given(st.text("ACGTacgtN", min_size=0, max_size=120), st.sampled_from([4, 7, 21, 31]), st.sampled_from([1, 2, 5]))
def test_sketch_equals_plain(seq, k, scaled):
    pos, h = S.sketch(seq.encode(), k, scaled)
    assert list(zip(pos.tolist(), [int(x) for x in h])) == plain_sketch(seq, k, scaled)


def test_strand_steps_and_downsampling():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 5000)
    seq = bytes(np.frombuffer(b"ACGT", np.uint8)[codes])
    back = bytes(np.frombuffer(b"ACGT", np.uint8)[S.reverse_complement_codes(codes.astype(np.uint8))])
    one, two = S.sketch(seq, 21, 5), S.sketch(back, 21, 5)
    assert sorted(one[1].tolist()) == sorted(two[1].tolist())
    few = S.sketch(seq, 21, 5, step=137)
    assert (few[0] == one[0]).all() and (few[1] == one[1]).all()
    coarse = S.sketch(seq, 21, 50)
    assert (one[1][one[1] <= np.uint64(S.max_hash(50))] == coarse[1]).all()
    assert S.reverse_complement_codes(np.array([0, 1, 2, 3, 4], np.uint8)).tolist() == [4, 0, 1, 2, 3]


def test_parameters():
    with pytest.raises(ValueError):
        Params(k=3)
    with pytest.raises(ValueError):
        Params(embed_scaled=5)


def test_hits_chunks_and_kmers(spark):
    rng = np.random.default_rng(2)
    seq = "".join("ACGT"[i] for i in rng.integers(0, 4, 1500)) + "NN" + "acgtacgtacgtacgtacgtacgtacgt"
    df = spark.createDataFrame([("c", seq), ("e", ""), ("n", None)], "contig string, seq string")
    got = {(r["pos"], r["h"] & M) for r in K.hits(df, 21, 5).collect()}
    assert got == set(plain_sketch(seq, 21, 5))
    cut = K.chunked(df, 21, 100).collect()
    assert len(cut) == -(-len(seq) // 100) and all(len(r["seq"]) <= 120 for r in cut)
    kmers = {(r["pos"], r["kmer"]) for r in K.kmers(df, 21, piece=50).collect()}
    f = lambda s: min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert kmers == {(i, f(seq[i : i + 21].upper())) for i in range(len(seq) - 20) if "N" not in seq[i : i + 21]}


def test_bin_stats_and_store(spark):
    df = spark.createDataFrame([("c", "ACGTNNGGCC" * 10)], "contig string, seq string")
    rows = K.bins(df, 50).orderBy("bin").collect()
    assert [r["acgt"] for r in rows] == [40, 40] and [r["gc"] for r in rows] == [0.75, 0.75]
    hits = spark.createDataFrame([("c", b, h) for b, h in zip([1, 0, 1, 1, 0], [7, 3, 7, 5, 3])], "contig string, pos bigint, h bigint")
    assert sorted((r["bin"], r["h"], r["n"]) for r in K.store(hits, 1).collect()) == [(0, 3, 2), (1, 5, 1), (1, 7, 2)]


def test_matrix_and_pairs(spark):
    store = spark.createDataFrame([("c", 0, 1, 1), ("c", 0, 2, 4), ("c", 1, 2, 2), ("c", 1, 3, 1), ("c", 2, 9, 1)], "contig string, bin bigint, h bigint, n bigint")
    dim = spark.createDataFrame([("c", b) for b in range(3)], "contig string, bin bigint")
    assert [r["private_frac"] for r in K.private_fraction(dim, store).orderBy("bin").collect()] == [0.5, 0.5, 1.0]
    from pyspark.sql import functions as F

    assert sorted((r["bin"], r["h"], round(r["w"], 9)) for r in K.tfidf(store, F.lit(3)).collect()) == [(0, 2, 1.0), (1, 2, 1.0)]
    sets = {0: [1, 2, 3, 4], 1: [3, 4, 5, 6], 2: [1, 2]}
    s = spark.createDataFrame([("c", b, h, 1) for b, hs in sets.items() for h in hs], "contig string, bin bigint, h bigint, n bigint")
    got = {(r["bin_a"], r["bin_b"]): r for r in K.pairs(s, 21).collect()}
    assert got[0, 1]["jacc"] == pytest.approx(2 / 6) and got[0, 2]["jacc"] == 0.5 and got[0, 2]["cani"] == 1
    assert got[0, 1]["cani"] == pytest.approx(0.5 ** (1 / 21)) and (1, 2) not in got


def test_files(spark, tmp_path):
    from sketchloom.sources import files as R

    text = "junk\n>a x > y\nACGT\nac\n>b\n\n>c\nGG\n"
    (tmp_path / "x.fa").write_text(text[5:])
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(text[5:])
    for name in ("x.fa", "y.fa.gz"):
        assert sorted((r["contig"], r["seq"]) for r in R.fasta(spark, str(tmp_path / name)).collect()) == [("a", "ACGTac"), ("c", "GG")]
    (tmp_path / "r.fq").write_text("@r1 z\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    assert [tuple(r) for r in R.fastq(spark, str(tmp_path / "r.fq"), 3).collect()] == [("r1", "ACGT", "IIII")]
    (tmp_path / "t.bed").write_text("track name=x\nchr1\t5\t9\tfoo\nchr2\t\t3\tbar\n")
    assert [tuple(r) for r in R.bed(spark, str(tmp_path / "t.bed")).collect()] == [("chr1", 5, 9, "foo")]
    dim = spark.createDataFrame([("c", 0)], "contig string, bin bigint")
    store = spark.createDataFrame([("c", 0, 5, 1)], "contig string, bin bigint, h bigint, n bigint")
    R.write_store(store, dim, str(tmp_path / "s"), Params())
    assert R.read_store(spark, str(tmp_path / "s"), Params())[0].count() == 1
    with pytest.raises(ValueError):
        R.read_store(spark, str(tmp_path / "s"), Params(k=31))


def test_stream_equals_batch(spark, tmp_path):
    from sketchloom.streaming.sketching import stream_store

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "".join("ACGT"[j] for j in rng.integers(0, 4, 400))) for i in range(6)], "contig bigint, seq string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream_store(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 21, 5, 100).writeStream.format("memory").queryName("sketches").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sketches").collect())) == sorted(map(tuple, K.store(K.hits(df, 21, 5), 100).collect()))
