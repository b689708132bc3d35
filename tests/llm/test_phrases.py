"""Phrase mining against brute force, SQL and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import phrases


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, max_n=3, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in long.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= covered * c[p[i:j]]}
        kept = []
        for p, a in long.items():
            if p not in gone:
                score, cut = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def texts(seed, many=300, vocabulary=12):
    r = random.Random(seed)
    pool = ["the", "The", "A", "b%", "é", "😀x", "a\x01", "a", "\x00", "word"] + [f"w{i}" for i in range(vocabulary)]
    return [(r.choice(["en", "en", "de", None, "x%09", "t\tab"]), "".join(r.choice(pool) + r.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b", "\xa0"]) for _ in range(r.randint(0, 60)))) for _ in range(many)]


@pytest.mark.parametrize("max_n, least, top", [(3, 10, 2000), (2, 3, 7), (5, 4, 2000)])
def test_collocations(spark, max_n, least, top):
    rows = texts(max_n)
    df = spark.createDataFrame([(*x, 1) for x in rows], "lang string, text string, phrase int").repartition(4)
    assert found(phrases.collocations(df, max_n, least, top=top)) == brute(rows, max_n, least, top=top)


def test_hot_words_go_to_several_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STEP", 600)
    rows = [("en", "hot word " * 40 + " ".join(f"hot w{i % 7} x{i % 3}" for i in range(30))) for _ in range(12)] + texts(9, 100)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    words = phrases.word_counts(df)
    got = {(r["lang"], " ".join(r["words"])): r["f"] for r in phrases.phrase_counts(df, words, part_words=200).collect()}
    want = Counter()
    for lang, text in rows:
        for w in pieces(text):
            want.update((lang or "und", " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == {k: v for k, v in want.items() if v >= 10}
    assert {(r["lang"], r["word"]): r["f"] for r in words.collect()} == {k: v for k, v in want.items() if len(k[1].split(" ")) == 1}


@pytest.mark.parametrize("max_n", [3, 8])
def test_parts_hold_so_many_words(spark, max_n):
    """Longer suffixes go to more parts, so that what a task sorts stays as large."""
    r = random.Random(max_n)
    df = spark.createDataFrame([("en", " ".join(f"w{r.randint(0, 999)}" for _ in range(500))) for _ in range(40)], "lang string, text string")
    sorted_by_part = phrases.dealt(df, phrases.word_counts(df), max_n, part_words=3000).select(F.spark_partition_id().alias("part"), (F.size(F.split("key", "\t")) - 3).alias("words"))
    held = [x["words"] for x in sorted_by_part.groupBy("part").agg(F.sum("words").alias("words")).collect()]
    assert 0.9 * 20_000 * max_n < sum(held) <= 20_000 * max_n and max(held) <= 2 * 3000


def test_nothing_is_written_between_parts_and_phrases(spark, monkeypatch):
    names, write = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, name: names.append(name) or write(df, name))
    rows = texts(2, 60)
    assert found(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)
    assert names == ["words", "phrases", "scored"]


def test_many_words_in_one_text(spark):
    r = random.Random(4)
    rows = [("en", " ".join(f"v{r.randint(0, 40)}" for _ in range(60_000))), ("en", "x" * 100_000), ("en", "")]
    assert found(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)


def test_codes_that_pass_a_word(spark):
    rows = [("en", " ".join(f"u{i}" for i in range(30_000)) + " one two three four five six" * 12)]
    assert found(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), max_n=6)) == brute(rows, 6)


def test_ties_and_none(spark):
    rows = [("en", f"{a}{i} {b}{i}.") for a, b in (("m", "n"), ("k", "l"), ("é", "e")) for i in range(30) for _ in range(10)]
    assert found(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), top=25)) == brute(rows, top=25)
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\n")], "lang string, text string")).count() == 0


def test_large_counts_are_exact(spark):
    """a^2 * 10^6 passes 64 bits."""
    a, left, right = 3_000_000_007, 7_000_000_003, 5_000_000_021
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    got = df.selectExpr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) s").first()["s"]
    assert got == 1000000 * a * a // (left * right)


def test_stack_over_batches():
    rows = sorted(((f"1\ten\t{a}\t{b}\t", 1 + i) for i, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "a"), ("a\x01", "a"), ("b", "z")])), reverse=True)
    want = Counter()
    for k, n in rows:
        w = k.split("\t")
        want["\t".join(w[:3]) + "\t"] += n
        want[k] += n
    for size in (1, 2, 5):
        stack, got = phrases.Stack(2, 1), []
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            got += stack.push(pa.array([k for k, _ in part]), __import__("numpy").array([n for _, n in part]))
        got += stack.close(1) + stack.close(2)
        assert {k.decode(): n for k, n in got} == want and len(got) == len(want)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    a, b = (x.sort_values(["lang", "rank"]).reset_index(drop=True) for x in (phrases.op11_suffix_sigma(spark, sf).toPandas(), con.sql(phrases.OP11_SQL).df()))
    assert len(a) == len(b) > 0 and (a == b[a.columns]).all().all()
