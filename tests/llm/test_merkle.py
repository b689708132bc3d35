"""The Merkle manifest against brute force, SQL and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, root int, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root and, for each node, its proof: (place, others) a level."""
    own, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for leaf, i in enumerate(own):
            run = runs[i // 8]
            proofs[leaf].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        nodes, own = [h(*r) for r in runs], [i // 8 for i in own]
    return nodes[0], proofs


def fold(leaf, proof):
    for place, others in proof:
        leaf = h(*others[:place], leaf, *others[place:])
    return leaf


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof hash, folded, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, r[2] or ""), []).append(r)
    trees = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, record(r)))
        trees[g] = (own, *climb([record(r) for r in own]))
    order = sorted(trees)
    root, above = climb([trees[g][1] for g in order])
    out = []
    for g, upper in zip(order, above):
        own, subroot, proofs = trees[g]
        for r, proof in zip(own, proofs):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if bent else r[4]
            folded = fold(record((*r[:4], text)), proof + upper)
            out.append((r[0], record(r), subroot, root, h(*(x for _, o in proof + upper for x in o)), folded, folded == root))
    return sorted(out, key=repr)


def digest(got):
    got = got.select("id", "leaf", "subroot", "root", F.sha2(F.array_join(F.flatten("proof.others"), ""), 256), merkle.folded(F.col("claim"), F.col("proof")).alias("folded"))
    return sorted(((*r, r["folded"] == r["root"]) for r in got.collect()), key=repr)


def bent_manifest(df, per_part):
    text = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    return merkle.manifest(df, claim=merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text), per_part=per_part)


@pytest.mark.parametrize("per_part", [7, 40, 1000])
def test_manifest(spark, per_part):
    r = random.Random(per_part)
    sizes = {"en": 150, None: 9, "": 1, "de": 8, "é": 17, "𐀀": 2, "￿": 3, **{f"x{i}": r.randint(1, 20) for i in range(12)}}
    rows = [(r.choice([None, *range(-50, 2000)]), r.choice([None, "", "a", "é"]), g, r.choice([None, 7]), r.choice([None, "", "Some Text", "é😀 A", "plain"])) for g, n in sizes.items() for _ in range(n)]
    rows += [rows[3]] * 30  # equal rows are leaves each
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA).repartition(5)
    assert digest(bent_manifest(df, per_part)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    rows = [(i, "s", "en", i, f"T {i}") for i in range(n)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA)
    assert digest(bent_manifest(df, 10)) == brute(rows)


def test_one_key_for_most_rows(spark):
    rows = [(1, "s", "en", 1, "A text")] * 200 + [(i, "s", "en", 1, "b") for i in range(60)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA).repartition(4)
    tree_rows = bent_manifest(df, 20)
    assert digest(tree_rows) == brute(rows)


def test_long_and_none(spark):
    long = "Lorem " * 200_000
    df = spark.createDataFrame([(1, None, None, None, long, 1, 2)], SCHEMA)
    assert digest(bent_manifest(df, 10)) == brute([(1, None, None, None, long)])
    assert merkle.manifest(df.limit(0)).count() == 0


def test_ids_of_other_kinds(spark):
    df = spark.createDataFrame([(x, "g", "t" + x) for x in "cab"], "key string, grp string, text string")
    got = merkle.manifest(df, fields=("key", "text"), group="grp", order="key").orderBy("id").collect()
    root, proofs = climb([record((x, "t" + x)) for x in "abc"])
    assert [(r["id"], r["root"], r["subroot"]) for r in got] == [(x, root, root) for x in "abc"]
    assert [[(p["place"], p["others"]) for p in r["proof"]] for r in got] == proofs


def test_grow_and_ragged():
    nodes = [h(str(i)) for i in range(100)]
    root, _ = climb(nodes)
    levels = merkle.grow(nodes, 0, 100)
    assert levels[-1][1:] == (1, [root]) and merkle.ragged(levels) == ([], [])
    left, runs = merkle.ragged(merkle.grow(nodes[3:30], 3, 100))
    assert {(a, i) for a, i, _, _ in left} == {(0, i) for i in [3, 4, 5, 6, 7, 24, 25, 26, 27, 28, 29]} | {(1, 1), (1, 2)}
    assert runs == [(0, 0), (0, 3), (1, 0), (2, 0)]


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (merkle.op13_merkle_manifest(spark, sf).toPandas(), con.sql(merkle.OP13_SQL).df()))
    assert len(a) == len(b) > 0 and (a == b[a.columns]).all().all() and not a.verified.all() and a.verified.any()
