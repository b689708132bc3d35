"""File sources, caches and sinks on odd files."""

import gzip

import pytest
from pyspark.sql import functions as F

from sketchloom.params import Params
from sketchloom.sources import files as R


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_quality_may_begin_with_at(spark, tmp_path):
    path = put(tmp_path / "r.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nACGTA\n+r2\n@III@\n@r3\nAC\n+\n@@\n")
    assert sorted(map(tuple, R.fastq(spark, path).collect())) == [("r1", "ACGT", "IIII"), ("r2", "ACGTA", "@III@"), ("r3", "AC", "@@")]
    assert [r["read"] for r in R.fastq(spark, path, 3).collect()] == ["r1", "r2"]
    assert [r["read"] for r in R.fastq(spark, path, 2, 2).collect()] == ["r1", "r2"]


def test_fastq_over_many_blocks(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (1 + i % 5), "@I@I" * (1 + i % 5)) for i in range(3000)]
    path = put(tmp_path / "big.fq", "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000"), spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = R.fastq(spark, path)
        assert R.numbered_lines(spark, path).rdd.getNumPartitions() > 3
        assert sorted(map(tuple, found.collect())) == sorted(rows)
        assert sorted(r["read"] for r in R.fastq(spark, path, 0, 7).collect()) == [f"r{i}" for i in range(7)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fasta_text_before_the_first_header(spark, tmp_path):
    odd = put(tmp_path / "odd.fa", ";a comment\nACGT\n>a one\nAC\nGT\n>b >c\nTT\n>empty\n")
    plain = put(tmp_path / "plain.fa", ">x\nAC\n>y\nGG\n")
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write("text\n>z\nCC\n")
    assert sorted((r["contig"], r["seq"]) for r in R.fasta(spark, odd).collect()) == [("a", "ACGT"), ("b", "TT")]
    assert sorted((r["contig"], r["seq"]) for r in R.fasta(spark, f"{tmp_path}/*.fa*").collect()) == [("a", "ACGT"), ("b", "TT"), ("x", "AC"), ("y", "GG"), ("z", "CC")]
    assert [r["contig"] for r in R.fasta(spark, plain, ("x",)).collect()] == ["y"]


def test_caches(spark, tmp_path):
    path, cache = put(tmp_path / "g.fa", ">a\nACGT\n>b\nGG\n"), str(tmp_path / "cache")
    assert sorted(r["contig"] for r in R.cached_contigs(spark, path, cache, ("b",)).collect()) == ["a"]
    assert sorted(r["contig"] for r in R.cached_contigs(spark, path, cache).collect()) == ["a", "b"]  # excluded ones are cached
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for version, many in (("v1", 1), ("v1", 1), ("v2", 2)):
        assert R.cached_scan(spark, str(tmp_path / "scan"), version, build).count() == 3 and len(built) == many
    put(tmp_path / "g.fa", ">a\nACGTACGT\n")
    assert [r["seq"] for r in R.cached_contigs(spark, path, cache).collect()] == ["ACGTACGT"]


def test_samples_and_tracks(spark, tmp_path):
    one = spark.createDataFrame([("c", 0, [5, 6], [0.5, 0.25])], "contig string, w bigint, ehits array<bigint>, ejacc array<double>")
    for name in ("S1.pat.x.parquet", "S1.mat.x.parquet", "S2.parquet"):
        one.toPandas().to_parquet(tmp_path / name)
    assert sorted((r["sample"], r["top"], r["j1"]) for r in R.samples(spark, f"{tmp_path}/*.parquet").collect()) == [("S1 mat", 5, 0.5), ("S1 pat", 5, 0.5), ("S2", 5, 0.5)]
    one.toPandas().to_parquet(tmp_path / "S2.again.parquet")
    with pytest.raises(ValueError, match="S2"):
        R.samples(spark, f"{tmp_path}/*.parquet")
    with pytest.raises(FileNotFoundError):
        R.satellites(spark, str(tmp_path / "none.bed"))
    track = put(tmp_path / "t.bed", "track x\nc1\t1\t5\thor_1_5(S1)\nc1\t7\t\tz\n")
    assert [tuple(r)[:3] for r in R.satellites(spark, track).collect()] == [("c1", 1, 5)]


def test_results(spark, tmp_path):
    path = str(tmp_path / "model")
    tables = {
        "z": spark.createDataFrame([(1, [1.0, 2.0])], "row int, z array<double>"), "sigma": spark.createDataFrame([(0, 2.0)], "dim int, sigma double"),
        "private": spark.createDataFrame([(1, 0.5)], "row int, private_frac double"), "meta": spark.createDataFrame([(21, 20, 200, 3)], "k int, scaled int, bin_bp int, n_shared int"),
    }
    R.write_result(tables, path, "model")
    assert {k: v.collect() for k, v in R.read_result(spark, path, "model").items()} == {k: v.collect() for k, v in tables.items()}
    with pytest.raises(ValueError, match="sigma"):
        R.write_result({k: v for k, v in tables.items() if k != "sigma"}, path, "model")
    with pytest.raises(ValueError, match="cluster"):
        R.write_result({"bins": tables["z"], "coordinates": tables["z"]}, path, "embedding")
    with pytest.raises(ValueError, match="model"):
        R.read_result(spark, path, "lab")


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "row int, x double")
    R.write_triage(rows, str(tmp_path / "t"))
    assert spark.read.csv(R.folder_of(spark, str(tmp_path / "t"), "tsv"), sep="\t", header=True).columns == ["row", "x"] and R.read_json(spark, str(tmp_path / "t")).count() == 2
    R.write_table(rows, str(tmp_path / "u"))
    assert R.read_table(spark, str(tmp_path / "u"), inferSchema=True).orderBy("row").collect() == rows.collect()
    for n in (2, 1):
        R.write_json(spark.range(n).select(F.struct("id").alias("s")), str(tmp_path / "j"))
    assert R.read_json(spark, str(tmp_path / "j")).count() == 1
    for stage, v in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        R.write_metrics(spark.createDataFrame([("m", v)], "name string, value double"), str(tmp_path / "m"), stage)
    assert sorted(map(tuple, R.read_metrics(spark, str(tmp_path / "m")).collect())) == [("a", "m", 3.0), ("b", "m", 2.0)]


class Stop(Exception):
    pass


def old_and_new(spark, path):
    params = Params()
    store = lambda n: (spark.range(n).selectExpr("id as contig", "0L as bin", "id as h", "1L as n"), spark.range(n).selectExpr("id as contig", "0L as bin"))
    table = lambda n: spark.createDataFrame([(i, "c", 0.5, [1], [1.0], [2], [1.0]) for i in range(n)], "w bigint, contig string, cover double, hits array<bigint>, sims array<double>, ehits array<bigint>, ejacc array<double>")
    return {
        "store": (lambda n: R.write_store(*store(n), path, params), lambda: tuple(x.count() for x in R.read_store(spark, path, params)) == (3, 3)),
        "cache": (lambda n: R.keyed(spark, path, f"v{n}", lambda: spark.range(n)), lambda: R.keyed(spark, path, "v3", lambda: spark.range(3)).count() == 3),
        "result": (lambda n: R.write_result({"rows": table(n)}, path, "scan"), lambda: R.read_result(spark, path, "scan")["rows"].count() == 3),
        "json": (lambda n: R.write_json(spark.range(n), path), lambda: R.read_json(spark, path).count() == 3),
        "table": (lambda n: R.write_table(spark.range(n), path), lambda: R.read_table(spark, path).count() == 3),
        "triage": (lambda n: R.write_triage(spark.range(n), path), lambda: R.read_json(spark, path).count() == 3),
        "metrics": (lambda n: R.write_metrics(spark.range(n).selectExpr("'m' as name", "1.0D as value"), path, "s"), lambda: R.read_metrics(spark, path).count() == 3),
    }


@pytest.mark.parametrize("sink", ["store", "cache", "result", "json", "table", "triage", "metrics"])
def test_a_stopped_sink_leaves_what_was_there(spark, tmp_path, monkeypatch, sink):
    """A run that stops before each of its steps: readers get the old rows, and the next run goes through."""
    write, whole = old_and_new(spark, str(tmp_path / sink))[sink]
    write(3)
    real = R._swap

    def before(*_):
        raise Stop

    monkeypatch.setattr(R, "_swap", before)
    with pytest.raises(Stop):
        write(5)
    assert whole()
    monkeypatch.setattr(R, "_swap", real)
    write_one, calls = R.publish, []

    def half(spark, path, writers, key=""):
        first = dict(list(writers.items())[:1])

        def stop(folder):
            calls.append(folder)
            raise Stop

        write_one(spark, path, first | {"stops": stop}, key)

    monkeypatch.setattr(R, "publish", half)
    with pytest.raises(Stop):
        write(5)
    assert whole() and calls
    monkeypatch.setattr(R, "publish", write_one)
    write(4), write(3)
    assert whole()


def test_old_versions_go(spark, tmp_path):
    path = tmp_path / "t"
    for n in range(4):
        R.write_json(spark.range(n), str(path))
    assert len([p for p in path.iterdir() if p.is_dir()]) == 2 and len([p for p in path.iterdir() if p.name == R.POINTER]) == 1
    with pytest.raises(FileNotFoundError):
        R.read_json(spark, str(tmp_path / "none"))


def test_fasta_in_pieces(spark, tmp_path):
    """Many small blocks: the same contigs as whole records give, piece by piece, and the same bins and hits."""
    import random

    from sketchloom.operators import sketch as K

    r = random.Random(5)
    bases = lambda n: "".join(r.choice("ACGTacgtN") for _ in range(n))
    records = [("chr1", bases(30_000)), ("none", ""), ("chr2", bases(1)), ("chr3", bases(9_999)), ("last", bases(70))] + [(f"s{i}", bases(r.randint(0, 300))) for i in range(60)]
    wrap = lambda s, w: "".join(s[i : i + w] + "\n" for i in range(0, len(s), w))
    put(tmp_path / "a.fa", ";odd\nACGT\n" + "".join(f">{n} some > words\n{wrap(s, 70)}\n" for n, s in records))
    put(tmp_path / "b.fa", ">b1\r\n" + bases(500) + "\r\n")
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(">z\n" + wrap(bases(2_000), 60))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500"), spark.conf.set("spark.sql.files.openCostInBytes", "1")
        whole = R.fasta(spark, f"{tmp_path}/*.fa*", ("chr2",))
        want = {x["contig"]: x["seq"] for x in whole.collect()}
        for size, overlap in ((400, 0), (1000, 20), (64, 130)):
            got = R.fasta_pieces(spark, f"{tmp_path}/*.fa*", size, overlap, ("chr2",)).collect()
            assert sorted((x["contig"], x["at"], x["seq"], x["length"]) for x in got) == sorted((n, at, s[at : at + size + overlap], len(s)) for n, s in want.items() for at in range(0, len(s), size))
        pieces = R.fasta_pieces(spark, f"{tmp_path}/*.fa*", 1000, 20, ("chr2",))
        assert sorted(map(tuple, K.piece_bins(pieces, 100, 1000).collect())) == sorted(map(tuple, K.bins(whole, 100).collect()))
        assert sorted(map(tuple, K.piece_hits(pieces, 21, 3).collect())) == sorted(map(tuple, K.hits(whole, 21, 3).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
