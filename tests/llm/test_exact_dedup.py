"""Exact dedup against brute force, SQL and on odd rows."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.llm import exact_dedup as ed


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**62), max_size=60) | st.sets(st.integers(0, 90), max_size=60))
def test_golomb_round_trip(values):
    ordered = np.array(sorted(values), np.uint64)
    assert np.array_equal(ed.decode(ed.encode(ordered)), ordered)


def test_golomb_is_short():
    ordered = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 20_000, np.uint64))
    bits = 8 * len(ed.encode(ordered)) / len(ordered)
    assert bits < np.log2((1 << 40) / len(ordered)) + 1.7


def brute(rows):
    of = {}
    for i, t in rows:
        of.setdefault(t or "", []).append(i)
    top = lambda ids: max((x for x in ids if x is not None), default=None)
    out = Counter((i, top(of[t or ""]), len(of[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    return out, Counter((top(v), k) for k, v in of.items())


def check(spark, rows, parts):
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id bigint, text string, kept int, `a.b` int").repartition(parts)
    got = ed.grouped(df).drop("text").collect()
    want, heads = brute(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got if r["kept"]) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for (i, t), n in heads.items() for _ in range(n))
    left = ed.deduplicated(df)
    assert left.columns == df.columns and left.count() == len(heads) and left.where("kept <> 7 or `a.b` <> 8").count() == 0


def test_groups(spark):
    rows = [(i, f"text {i % 70}" if i % 3 else "the same") for i in range(400)]
    rows += [(None, "text 1"), (None, None), (5, ""), (5, ""), (6, "text 6"), (6, "text 6"), (900, "é😀\x00"), (901, "É😀\x00"), (902, "x" * 300_000), (903, "x" * 300_000), (904, "alone "), (905, "alone")]
    check(spark, rows, 7)
    check(spark, rows, 1)


def test_null_ids_only(spark):
    check(spark, [(None, "a"), (None, "a"), (None, "b"), (None, None), (None, "")], 3)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ed.grouped(none).count() == 0 and ed.deduplicated(none).columns == none.columns


def test_chance_suspects_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ed, "SPARE", -4)  # fingerprints so short that most texts are suspects
    check(spark, [(i, f"t{i % 150}") for i in range(300)], 4)


def test_rows_do_not_travel(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6).select("doc_id", "text")
    plan = ed.grouped(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning(sender" in plan and plan.count("Exchange") == 1


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string").repartition(2)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in ed.grouped(df).collect()} == {("a", "b", False), ("b", "b", True), ("c", "c", True)}


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (ed.op12_golomb_exchange(spark, sf).toPandas(), con.sql(ed.OP12_SQL).df()))
    assert len(a) == len(b) > 0 and (a == b[a.columns]).all().all()
