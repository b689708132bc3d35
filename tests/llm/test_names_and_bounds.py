"""Clashing, dotted and differently cased column names in every stage; bounds on labelled rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sketchloom.llm import quality_rules, quality_subword, shingle_dedup, toxicity
from sketchloom.llm.common import written
from sketchloom.session import read

NAMES = ["Score", "Kept", "a.b", "_rest", "_row", "BASE_FAILED", "n_Words", "Keep_Id", "Size"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, sf, docs, name, stage):
    rows = docs.limit(80).select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    rows = written(rows, "named")
    got = stage(spark, rows, sf)
    assert got.columns == rows.columns
    assert got.count() > 0 and got.where(" or ".join(f"`{c}` <> {i}" for i, c in enumerate(NAMES))).count() == 0


def test_last_stage_takes_columns(spark, sf, docs):
    rows = docs.limit(30).select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() >= 30


def test_repeated_ids_pass_no_bound(spark, monkeypatch):
    """One labelled doc_id on very many rows gives one row to fit on."""
    rows = spark.range(3000).select((F.col("id") % 4 + 1).alias("doc_id"), F.concat(F.lit("some text of words "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 4)] * 2, "doc_id bigint, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality_subword, "fit", lambda rows, **_: seen.setdefault("subword", len(rows)) and quality_subword.Model(None, None, None))
    monkeypatch.setattr(quality_rules.boost, "fit", lambda x, y, m: seen.setdefault("rules", len(x)))
    monkeypatch.setattr(toxicity, "fit", lambda x, y, names: seen.setdefault("toxicity", len(x)) and toxicity.Model(names, [0.0] * len(names)))
    quality_subword.train(rows, labels)
    quality_rules.train(rows, labels)
    toxicity.train(rows, labels, least_z=-9.0)
    assert seen["subword"] <= 4 and seen["rules"] <= 4 and seen.get("toxicity", 1) <= 4


def test_texts_that_share_a_node(spark, monkeypatch):
    """Different texts under one 64-bit hash are no copies."""
    monkeypatch.setattr(shingle_dedup, "node_of", lambda text: F.xxhash64(F.substring(F.coalesce(text, F.lit("")), 1, 3)))
    rows = [(1, "abc one two three four five six"), (2, "abc seven eight nine ten eleven twelve"), (3, "abc one two three four five six"), (4, "xyz alone here with some words")]
    got = shingle_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4]
