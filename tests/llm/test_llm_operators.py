"""The training-data operators against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sketchloom.llm import boost, embed_dedup, line_dedup, lm_score, mixing, packing, pii, quality_rules, quality_subword, simhash_vp, toxicity
from sketchloom.llm.common import components, held_out
from sketchloom.session import read

WS = "\x20\x09-\x0d"
LONG = ("lorem ipsum dolor sit amet " * 9000).strip()
ODD = [
    (1, "A plain text of some words.\nAnd a line.", "en", "a", 1.5, True), (1, "A plain text of some words.\nAnd a line.", "en", "a", 1.5, True), (2, None, "en", None, 0.0, None), (3, "", None, "b", None, False),
    (None, "no id here, but words", "en", "b", 1.0, True), (4, LONG, "en", "a", 1.0, True), (5, "  \t\n\x0b\x0c\r ", "en", "a", 1.0, True), (6, "é😀 über　Straße\x00 end", "de", "c", 1.0, True), (7, "x" * 50_000, "en", "a", 1.0, True),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, score double, kept boolean"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return read(spark, sf, "labels")


def words(t):
    return re.findall(f"[^{WS}]+", t or "")


def test_held_out(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 37] + [(r.randint(400, 460), r.randint(400, 460)) for _ in range(40)] + [(500, x) for x in range(501, 560)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m), todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1, 10: classifiers ------------------------------------------------------------------


def test_boost_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(scale=0.3, size=2000) > 0).astype(float)
    m = boost.fit(x, y, {0: 1})
    assert ((m.score(x) > 0.5) == y).mean() > 0.85
    line = np.tile(rng.normal(size=(20, 3)), (50, 1))
    line[:, 0] = np.repeat(np.linspace(-3, 3, 50), 20)
    assert (np.diff(m.raw(line).reshape(50, 20), axis=0) >= -1e-9).all()
    assert boost.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality_statistics(docs, labels, odd, none):
    model = quality_rules.train(docs, labels)
    for rows in (docs, odd):
        got = quality_rules.judge(rows, model)
        text = {r["doc_id"]: r["text"] for r in rows.collect()}
        for r in got.collect():
            t = text[r["doc_id"]] or ""
            w = words(t)
            c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)) if len(w) < 5000 else {tuple(w[i : i + 8]): 2 for i in range(len(w) - 7)}
            hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            lines = [x for x in t.split("\n") if words(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
            assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(none, model).count() == 0
    assert quality_rules.passing(odd, model).columns == odd.columns
    keep_all = quality_rules.train(docs, labels.limit(0))
    assert quality_rules.judge(docs, keep_all).where("not base_failed and not kept").count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = quality_subword.classify(docs, quality_subword.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.9 and rows.score.between(0, 1).all()
    rules = quality_rules.judge(docs, quality_rules.train(docs, labels)).join(labels, "doc_id").where("not base_failed").where(held_out(F.col("doc_id"))).toPandas()
    assert (rules.kept == (rules.quality == 1)).mean() > 0.95


def test_subword_odd(odd, none, docs, labels):
    model = quality_subword.train(docs, labels)
    got = quality_subword.classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality_subword.classify(none, model).count() == 0
    flat = quality_subword.classify(odd, quality_subword.train(docs, labels.limit(0))).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in flat)


def test_toxicity(spark):
    rows = [(i, ("you are an idiot and a moron " if i % 3 == 0 else "a fine day in town ") + f"w{i}", 1, int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, c, d) for a, _, c, d in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert list(model.cuts) == sorted(model.cuts)
    got = {r["doc_id"]: r for r in toxicity.grades(docs, model).collect()}
    assert all(got[a]["toxic"] == bool(d) and 0 <= got[a]["severity"] <= 2 for a, _, _, d in rows)
    assert not any(r["toxic"] for r in toxicity.grades(docs, toxicity.train(docs, labels.limit(0))).collect())


def test_subword_scores_by_hand(spark, docs, labels):
    model = quality_subword.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 1500").limit(25).collect()] + [(-1, "again again again"), (-2, ""), (-3, None)]
    got = {r["doc_id"]: r["score"] for r in quality_subword.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    import pyarrow as pa

    for i, t in rows:
        w = words(t)
        own = [b for x in w for b in quality_subword.subwords(pa.array([x], pa.large_string()))[1]]
        for x in w[:5]:  # the word itself, and its n-grams with the word's bounds
            assert len(quality_subword.subwords(pa.array([x], pa.large_string()))[1]) == 1 + sum(max(0, len(x) + 2 - n + 1) for n in quality_subword.GRAMS)
        share = sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1)
        mean = model.vectors[own].astype(float).mean(0) if own else np.zeros(model.vectors.shape[1])
        mean = (mean + share * model.vectors[quality_subword.AGAIN]) / (1 + share)
        z = mean @ model.weights.astype(float) + model.bias
        p = np.exp(z - z.max())
        assert got[i] == pytest.approx(p[1] / p.sum(), abs=1e-5)


def test_toxicity_by_hand(spark, docs, labels):
    model = toxicity.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 3000").limit(60).collect()] + [(-1, "You IDIOT, you stupid loser! Loser."), (-2, None)]
    got = {r["doc_id"]: r for r in toxicity.grades(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    import regex

    for i, t in rows:
        w = [regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", x.lower()) for x in words(t)]
        own = {"=" + x for x in w if x} | {"^" + x[:n] for x in w for n in toxicity.PREFIXES if len(x) > n}
        at = [model.names.index(f) for f in own if f in model.names]
        z = model.weights[at].sum() / max(1, len(at)) ** 0.5
        above = [1 / (1 + np.exp(-(z - c))) for c in model.cuts]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert got[i]["severity"] == pytest.approx(sum(above)) and got[i]["p_toxic"] == pytest.approx(above[0])
        assert got[i]["grade"] == int(np.argmax(each)) and got[i]["toxic"] == (above[0] >= model.toxic_at)


def test_toxicity_grades_given(spark):
    words_of = {0: "a fine day", 1: "you fool you", 2: "you vile scum you"}
    rows = [(i, words_of[i % 3] + f" w{i}", i % 3) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id bigint, grade int"))
    got = {r["doc_id"]: r for r in toxicity.grades(docs, model).collect()}
    mean = [np.mean([got[i]["severity"] for i, _, g in rows if g == k]) for k in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3 and np.mean([got[i]["grade"] == g for i, _, g in rows]) > 0.95


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.op2_ordinal_toxicity(spark, sf).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count() and np.mean([got[i] == bool(t) for i, t in known.items()]) > 0.9


def test_toxicity_odd(odd, none):
    model = toxicity.Model(["=plain"], np.array([50.0]), np.array([1.0, 2.0]))
    got = toxicity.grades(odd, model).collect()
    assert len(got) == len(ODD) and sum(r["toxic"] for r in got) == 2
    assert toxicity.grades(none, model).count() == 0


# 3: lines ----------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                where[key(x)].add(-1 if i is None else i)
    out = Counter()
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(where[key(x)]) >= 5 and max(where[key(x)]) != (-1 if i is None else i))]
        out[(i, len(every), len(every) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup(spark, odd, none, batches):
    r = random.Random(batches)
    pool = ["  The quick brown Fox jumps over the lazy dog again %d\t" % i for i in range(6)] + ["short", "", "é" * 40, "é" * 39]
    rows = [(i, "\n".join(r.choice(pool).upper() if r.random() < 0.3 else r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, "\n".join(pool)), (99, None), (None, "x")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_lines int").repartition(4)
    got = Counter((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in line_dedup.deduplicated(df, batches).collect())
    assert got == brute_lines(rows)
    assert line_dedup.deduplicated(odd).count() == len(ODD) and line_dedup.deduplicated(none).count() == 0


def test_line_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    a = line_dedup.op3_line_dedup(spark, sf).toPandas()[cols].sort_values("doc_id").reset_index(drop=True)
    b = con.sql(line_dedup.OP3_SQL).df()[cols].sort_values("doc_id").reset_index(drop=True)
    assert len(a) == len(b) and (a == b).all().all()


def test_line_dedup_long_texts(spark):
    n = 100_000
    text = "\n".join(f"this is line number {i} of a long text with many lines" for i in range(n))
    df = spark.createDataFrame([(i, text, i) for i in range(6)], "doc_id bigint, text string, _lost int").repartition(6)
    got = line_dedup.deduplicated(df).select("doc_id", "n_lines", "n_dropped", F.length("kept_text"), "_lost").collect()
    assert {tuple(r) for r in got} == {(i, n, n if i < 5 else 0, 0 if i < 5 else len(text), i) for i in range(6)}


CLASH = ["_row", "_text", "_lost", "_of", "_kept", "_tie", "tie", "nth", "_copy", "_node", "_id", "_new", "_email", "keys"]


def test_clashing_names(spark, docs):
    rows = docs.limit(60).select("*", *[F.lit(7).alias(c) for c in CLASH])
    model = pii.train(spark, 200)
    for got in (line_dedup.deduplicated(rows), pii.spans(rows, model), mixing.sampled(rows), simhash_vp.deduplicated(spark, rows)):
        assert [c for c in got.columns if c in rows.columns] == rows.columns
        assert got.count() > 0 and got.where(" or ".join(f"{c} <> 7" for c in CLASH)).count() == 0


# 4: personal data ---------------------------------------------------------------------


def brute_pii(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group(0))
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group(0).split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m))


def test_pii(spark, odd, none):
    r = random.Random(3)
    texts = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713+44 20 7946 0958", "", None, "0" * 30 + "1.0001.2.255", "1 " * 500, "😀 a@b.co 10.0.0.1 😀", "x" * 3000 + "@d.co", "ä@b.co\n+1\n234567890"]
    texts += ["".join(r.choice("ab1+. -@(05)é") for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    model = pii.train(spark)
    got = pii.spans(df, model).select("*", F.sha2(pii.digest(F.col("base")), 256).alias("sha")).collect()
    for x in got:
        want = brute_pii(x["text"] or "")
        assert x["sha"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest(), x["text"]
        assert [x["n_" + k] for k in pii.KINDS] == [sum(w[1] == i for w in want) for i in range(4)]
        assert set(map(tuple, x["base"])) <= set(map(tuple, x["spans"]))
    found = pii.spans(spark.createDataFrame([(1, "mail john (at) example (dot) com or call (415) 555-2671 now")], "doc_id bigint, text string"), model).first()["spans"]
    assert {s["kind"] for s in found} == {"email", "phone"}
    clean = pii.spans(spark.createDataFrame([(1, "on 2024-01-02 at 10:30:00 we sold 1,234 units of 3.14159 kg, see 12345678")], "doc_id bigint, text string"), model).first()["spans"]
    assert clean == []
    assert pii.spans(odd, model).count() == len(ODD) and pii.spans(none, model).count() == 0


def test_pii_long_texts(spark):
    n = 10_000
    texts = [" ".join(f"user{i}@example.com" for i in range(n)), " ".join(f"10.2.{i % 256}.{i // 256} +1 415 555 {i:04d}," for i in range(n // 2)), "1 " * 1000, "é😀 x@y.co " * 2000]
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4), pii.train(spark, 300)).collect()
    for x in got:
        want = [(a, e, pii.KINDS[k]) for a, k, e in brute_pii(x["text"])]
        assert [tuple(b) for b in x["base"]] == want and set(want) <= {tuple(b) for b in x["spans"]}
        assert [tuple(b) for b in x["spans"]] == sorted((tuple(b) for b in x["spans"]), key=lambda b: (b[0], pii.KINDS.index(b[2])))


def test_pii_side_by_side(spark):
    texts = ["415-555-2671 (415) 555-2672", "415-555-2671 2024-01-02", "call 10.20.30.40 415-555-2671 now", "1 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pii.with_candidates(pii.with_base(df)).select("_row.doc_id", F.transform("_candidates", lambda c: F.struct(c["s"], c["e"], c["kind"])).alias("c")).collect()
    got = {(r["doc_id"], pii.KINDS[k], texts[r["doc_id"]][s:e]) for r in rows for s, e, k in r["c"]}
    assert {(0, "phone", "415-555-2671"), (0, "phone", "(415) 555-2672"), (1, "phone", "415-555-2671"), (2, "phone", "415-555-2671"), (2, "ip", "10.20.30.40")} <= got
    assert all(7 <= len(re.sub("[^0-9]", "", m)) <= 19 for _, k, m in got if k in ("card", "phone"))
    model = pii.train(spark)
    found = {r["doc_id"]: {(x["kind"], texts[r["doc_id"]][x["start"] : x["end"]]) for x in r["spans"]} for r in pii.spans(df, model).collect()}
    assert ("phone", "415-555-2671") in found[0] and ("phone", "415-555-2671") in found[1]


# 5: language models ---------------------------------------------------------------------


def test_lm_scores(spark):
    rows = [(i, "the cat sat on the mat " * 3 if i % 2 else "zx qq vv kk pp " * 4) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy(docs, labels).collect()}
    assert min(got[i] for i in range(100) if i % 2) > max(got[i] for i in range(100) if not i % 2)


def brute_losses(rows, good):
    """(n, target loss, background loss) of each text under exact n-gram counts."""
    split = [words((t or "").lower()) for _, t in rows]
    pairs = [list(zip([None, *w], w)) for w in split]
    vocabulary, p = len({x for w in split for x in w}) + 1, []
    for on in ([i in good for i, _ in rows], [True] * len(rows)):
        uni, two = Counter(x for w, o in zip(split, on) if o for x in w), Counter(x for w, o in zip(pairs, on) if o for x in w)
        head, total = Counter(uni) + Counter({None: sum(bool(w) and o for w, o in zip(split, on))}), sum(uni.values())
        one = lambda b, uni=uni, total=total: (uni[b] + lm_score.PRIOR) / (total + lm_score.PRIOR * vocabulary)
        p.append(lambda a, b, two=two, head=head, one=one: lm_score.MIX * two[a, b] / head[a] + (1 - lm_score.MIX) * one(b) if head[a] else one(b))
    return [(len(w), *(sum(-np.log(f(a, b)) for a, b in w) / max(len(w), 1) for f in p)) for w in pairs]


@pytest.mark.parametrize("fan", [4096, 5])
def test_lm_counts_every_ngram(spark, odd, none, monkeypatch, fan):
    # more different words than the fixed table has ids
    r = random.Random(5)
    rows = [(i, " ".join(f"W{r.randrange(400_000)}" if r.random() < 0.8 else r.choice(["the", "Of", "and"]) for _ in range(6000))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "the Of and"), (3, "the and"), (3, "the and")]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(lm_score, "FAN", fan)
    monkeypatch.setattr(lm_score, "PART", 1 << 16)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 1 << 18)
    want = brute_losses(rows, {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 5})
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    got = sorted(((x["doc_id"], x["n_words"], x["target_loss"], x["background_loss"], x["score"]) for x in lm_score.cross_entropy(docs, labels).collect()), key=key)
    want = sorted(((i, *x, x[2] - x[1]) for (i, _), x in zip(rows, want)), key=key)
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9) for a, b in zip(got, want))
    far = lm_score.cross_entropy(odd, labels.limit(0)).collect()
    assert len(far) == len(ODD) and all(x["score"] == 0 for x in far if x["n_words"] == 0)
    assert lm_score.cross_entropy(none, labels).count() == 0


def test_lm_route_sends_few_rows():
    """Each sender has at most fan receivers, each node at most about fan senders, and all chunks meet at a part."""
    chunks, fan, keys = 100, 5, np.sort(np.random.default_rng(1).integers(0, 1 << 64, 4000, np.uint64))
    route = lm_score.Route(chunks, (3, 120), fan)
    assert route.levels == 3
    sent = {(None, c): (c, keys) for c in range(chunks)}
    for level in range(1, route.levels + 1):
        asked = {}
        for sender, (group, own) in sent.items():
            to = list(route.split(own, 1, group, level))
            assert len(to) <= fan and [n for n, _ in to] == sorted(n for n, _ in to) and sum(at.stop - at.start for _, at in to) == len(own)
            for node, at in to:
                asked.setdefault(node, []).append(own[at])
        assert max(map(len, asked.values())) <= fan
        sent = {(level, node): (route.below(node, level)[1], np.unique(np.concatenate(x))) for node, x in asked.items()}
    assert len(sent) == 120 and np.array_equal(np.sort(np.concatenate([x for _, x in sent.values()])), keys)


# 6: mixing ------------------------------------------------------------------------------


def test_targets():
    for sizes in ([10, 10, 10], [1, 1000, 3], [5], [0, 10, 0], [100] * 7 + [1] * 5, [0, 0]):
        t, w = mixing.weighed(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))
        units = [x / v for x, v, s in zip(t, w, sizes) if x < 3 * s - 1e-9]
        assert not units or max(units) == pytest.approx(min(units))
        assert all(3 * s / v <= min(units) + 1e-9 for x, v, s in zip(t, w, sizes) if units and x >= 3 * s - 1e-9)
    drawn = mixing.shards([1000, 0, 70_000, 31], 3)
    assert Counter({i: sum(c for _, j, _, c in drawn if j == i) for i in range(4)}) == Counter({0: 1000, 1: 0, 2: 70_000, 3: 31})


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_mixing(docs, odd, none):
    got = mixing.mixed(docs).toPandas()
    text = {r["doc_id"]: r for r in docs.collect()}
    assert (got["size"] == [len(words(text[i]["text"])) for i in got.doc_id]).all() and (got.taken <= 3 * got["size"]).all()
    got["source"] = [text[i]["source"] for i in got.doc_id]
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and ((by.taken - by.target).abs() <= 40).all()
    again = mixing.mixed(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))
    kept = mixing.sampled(docs).toPandas()
    assert kept.groupby("doc_id").text.apply(lambda s: sum(len(words(t)) for t in s)).to_dict() == {i: t for i, t in zip(got.doc_id, got.taken) if t}
    assert all(set(words(t)) <= set(words(text[i]["text"])) for i, t in zip(kept.doc_id, kept.text))
    few = mixing.mixed(odd).collect()
    assert len(few) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in few)
    assert mixing.mixed(none).count() == 0 and mixing.sampled(none).count() == 0 and mixing.sampled(odd).columns == odd.columns


def test_taken_by_block_walk(spark):
    r = random.Random(6)
    rows = [(i, " ".join(f"w{k}" for k in range(r.randint(0, 90))), r.choice(["a", "b", "c", None])) for i in range(80)] + [(3, "again and again", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = Counter((x["doc_id"], x["size"], x["taken"]) for x in mixing.mixed(docs, block=8).collect())
    laid, sources = mixing.laid_out(docs)
    target, want = mixing.weighed([n for _, n in sources]), Counter()
    for (source, n), t, k in zip(sources, target, range(len(sources))):
        blocks = -(-n // 8)
        slots = min(3 * blocks, round(t / (n / blocks)))
        # each slot's block, one pass over the source after another
        at = spark.range(slots).select(mixing.permuted(F.col("id") % blocks, F.lit(blocks).cast("long"), F.xxhash64(F.lit(mixing.SEED), F.lit(k), F.expr(f"id div {blocks}"))).alias("b")).collect()
        times = Counter(x["b"] for x in at)
        for d in laid.where(F.col("source").eqNullSafe(F.lit(source))).collect():
            want[(d["doc_id"], d["size"], sum(times[w // 8] for w in range(d["begin"], d["begin"] + d["size"])))] += 1
    assert got == want


# 7: vectors -----------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    rows = [base[i] for i in range(300)] + [base[i % 20] + rng.normal(scale=0.12, size=16) for i in range(200)] + [base[0]] * 30
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(rows)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, []), (1005, [1.0] * 3), (1006, [0.0] * 16)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + bad], "vec_id bigint, embedding array<float>, n_links int").repartition(5)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= s.sum(1)).all() and found.sum() >= 0.9 * s.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in bad)
    label = np.arange(len(rows))
    for _ in range(50):
        label = np.minimum(label, np.where(s, label[None, :], len(rows)).min(1))
    same = np.mean([got[i]["component_id"] == label[i] for i in range(len(rows))])
    assert same > 0.95 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [3.0, 0.0, 0.01])], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(two).collect()} == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3)}


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    index = embed_dedup.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 5000)
    a, b = index.halves(x[:5])
    for i in range(5):
        total = (a[i][:, None] + b[i][None, :]).ravel()
        got = index.order(x[i : i + 1], 20)[0]
        assert np.allclose(np.sort(total)[: len(got)], total[got])


# 8: packing -----------------------------------------------------------------------------


def check_packing(rows, got, capacity=1024):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(r["length"] for r in got)


def test_packing(docs, odd, none):
    for df in (docs, odd):
        many, total = check_packing([(r["doc_id"], r["text"]) for r in df.collect()], packing.pack(df).collect())
        assert many <= 1.03 * total / 1024 + 1
    assert packing.pack(none).count() == 0
    one = packing.pack(docs.limit(3), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in one)


def test_encoder():
    e = packing.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    import pyarrow as pa

    texts = ["a  b", "a\n\nb", "a \nb", "a\n b", " lead", "trail ", "x\n", "\n\n", "  ", "a   b", "a\tb", "<|endoftext|> hi", "don't I'll", "", "é\n\n\nb", "  x  y ", "a\x1cb", "q​w", " \n x", "a　b", "\0"]
    assert [x.tolist() for x in e.encode(pa.array(texts, pa.large_string()))] == [e.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_vector_constraints():
    r = random.Random(8)
    counts = Counter(r.randint(1, 1024) for _ in range(2000)) + Counter({3: 500})
    for limits in ({}, {"max_docs": 4}, {"max_cost": 1024 * 1024}, {"max_docs": 3, "score": "dot"}):
        plan = packing.vector_best_fit(dict(counts), 1024, **limits)
        length = np.repeat(list(counts), list(counts.values()))
        rank = np.concatenate([np.arange(c) for c in counts.values()])
        seq, off = plan.place(length, rank)
        used = np.bincount(seq, length, plan.sequences)
        assert used.max() <= 1024 and len(set(zip(seq.tolist(), off.tolist()))) == len(length) and (np.bincount(seq) > 0).all()
        assert np.bincount(seq).max() <= limits.get("max_docs", 1024)
        if not limits:
            assert plan.sequences <= 1.02 * length.sum() / 1024 + 1
    tight = packing.vector_best_fit({512: 10}, 1024, max_cost=512**2)
    assert tight.sequences == 10
    with pytest.raises(ValueError):
        packing.vector_best_fit({600: 1}, 1024, max_cost=512**2)


# 9: SimHash -----------------------------------------------------------------------------


def brute_fp(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(docs, odd, none):
    for df in (docs, odd):
        text = [(r["doc_id"], r["text"]) for r in df.collect() if len(r["text"] or "") < 60_000]
        got = Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in simhash_vp.fingerprints(df).collect() if r["doc_id"] != 4 or df is docs)
        assert got == Counter((i, brute_fp(t)) for i, t in text)
    assert simhash_vp.classes(none).count() == 0
    got = {r["doc_id"]: r["component_id"] for r in simhash_vp.classes(odd).collect()}
    assert got[2] == got[3] == got[5] == 2 and got[1] == 1
    left = [r["doc_id"] for r in simhash_vp.deduplicated(odd.sparkSession, odd).collect()]
    assert sorted(x for x in left if x is not None) == [1, 2, 4, 6, 7] and left.count(None) == 1


@pytest.mark.parametrize("few, many, part", [(1 << 24, 1 << 30, 4096), (1 << 24, 1 << 30, 40), (1, 1 << 30, 300), (1, 2, 4096)])
def test_trees_find_all_pairs(spark, monkeypatch, few, many, part):
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(1500)]
    for _ in range(1500):
        x = r.choice(fps)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randint(0, 63)
        fps.append(x)
    fps += [fps[0] ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]  # a dense group: its parts are dealt in tiles
    fps = np.array(sorted(set(fps)), np.uint64)
    monkeypatch.setattr(simhash_vp, "FEW", few), monkeypatch.setattr(simhash_vp, "MANY", many)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(6)
    trees = simhash_vp.plant(df, len(fps), sample=800, leaf=100)
    assert all(t.leaves > 4 and t.radius == 1 for t in trees)
    visits = [sum(len(rows) for _, rows in t.route(fps, 1)) for t in trees]
    assert sum(visits) < 0.6 * sum(t.leaves for t in trees) * len(fps)  # the triangle bound prunes
    got = {x["node"]: x["component"] for x in components(simhash_vp.links(df, trees, len(fps), part=part)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in range(60):
        label = np.minimum(label, np.where(near, label[None, :], len(fps)).min(1))
    own = fps.view(np.int64)
    mine = [got.get(int(x), int(x)) for x in own]
    pairs = lambda v: {tuple(np.flatnonzero(np.array(v) == k)) for k in set(v)}
    assert pairs(mine) == pairs([int(own[k]) for k in label])


def test_views_cover_every_pair():
    r = random.Random(4)
    for n in (10, simhash_vp.FEW + 1, simhash_vp.MANY + 1):
        for radius in (2, 3, 4, 6):
            views = simhash_vp.views_for(n, radius)
            for _ in range(300):
                x = sum(1 << b for b in r.sample(range(64), radius))
                assert any((x & mask).bit_count() <= own for mask, own in views)


def test_stage_drops_near_copies(spark):
    r = random.Random(11)
    rows = []
    for i in range(120):
        w = [f"w{r.randrange(5000)}" for _ in range(r.choice([12, 80, 300]))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(r.randint(0, 4)):  # copies of copies, so chains of links too
            w = list(w)
            for _ in range(max(1, int(len(w) * r.choice([0.005, 0.01, 0.02, 0.04])))):
                w[r.randrange(len(w))] = f"z{r.randrange(9**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(7, "another text under the id of a text"), (None, rows[3][1] + " end"), (None, "of no id"), (None, "of no id"), (5, rows[5][1])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (words(t) for _, t in rows)]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(rows))
    for _ in range(40):
        label = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    best = {k: min(order(i) for i in np.flatnonzero(label == k)) for k in set(label.tolist())}
    got = simhash_vp.deduplicated(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    at = {t: int(label[i]) for i, (_, t) in enumerate(rows)}
    assert sorted(at[x["text"]] for x in got) == sorted(best)
    assert all((x["doc_id"] is None, x["doc_id"] or 0) == best[at[x["text"]]] for x in got)
    assert len(rows) - len(best) > 80


def test_pipeline(spark, docs, sf):
    import corpus_pipeline as c

    rows, out = docs, {}
    for name, stage in c.STAGES:
        from sketchloom.llm.common import written

        out[name] = rows = written(stage(spark, rows, sf), name)
        if name != "packing":
            assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    assert out["line_dedup"].count() == out["quality_rules"].count() > out["simhash_dedup"].count() > 0
    assert out["simhash_dedup"].groupBy("doc_id").count().where("count > 1").isEmpty()
    check_packing([(r["doc_id"], r["text"]) for r in out["mixing"].collect()], out["packing"].collect())
