"""Phrase collocations (11): Suffix-sigma counts of phrases, scored by their weakest cut.

Each word starts a suffix, cut at max_n words or at its piece's end. A task sends a suffix
once for each few megabytes of text, with its number, to the part of its language and
first word, where suffixes are sorted reverse-lexicographically: all suffixes that share a
prefix are neighbours, and one stack of max_n counters counts all prefixes. First words
with more suffixes than half a part should hold are dealt to several parts by the rest of
the suffix; what those parts count of a prefix is added up afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, steps, texts_of, written

MAX_N, MIN_COUNT, COVERED, TOP = 3, 10, 50, 2000
#: Words that the suffixes of a part hold, max_n each: what a task sorts does not grow with max_n.
PART_WORDS = 4_000_000
#: Text bytes whose equal suffixes a task counts before it sends them.
STEP = 3 << 20
_TAB = "\t"  # ends each word of a suffix, so that a prefix of words is a prefix of the string

_KIND = np.zeros(256, np.uint8)  # 0: part of a word
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(doc, piece, code, words) of the words of all texts in order; words are sorted, word i being words[code[i]]."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = _LOWER[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    kind = _KIND[data]
    new = np.zeros(len(data) + 1, bool)  # a text starts here
    new[ends] = True
    word = kind == 0
    begin = np.flatnonzero(word & (np.append(True, ~word[:-1]) | new[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (np.append(~word[1:], True) | new[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(ends, begin, "right") - 1
    stops = np.searchsorted(np.flatnonzero(kind == 2), begin)
    piece = np.cumsum(np.diff(doc, prepend=-1).astype(bool) | np.diff(stops, prepend=-1).astype(bool))
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    flat = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[word])])
    coded = pc.dictionary_encode(flat)
    order = np.asarray(pc.array_sort_indices(coded.dictionary), dtype=np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return doc, piece, place[np.asarray(coded.indices, dtype=np.int64)], coded.dictionary.take(pa.array(order))


def _langs(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    """The language of each row as a number, and the languages."""
    coded = pc.dictionary_encode(batch.column(batch.schema.get_field_index("lang")))
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) over all texts."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, most=STEP):
                doc, _, code, words = tokens(texts_of(part))
                of, langs = _langs(part)
                if len(code):
                    key, n = np.unique(of[doc] * len(words) + code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(key // len(words))), words.take(pa.array(key % len(words))).cast(pa.large_string()).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    return _rows(docs).mapInArrow(op, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _escaped(lang: str) -> str:
    return lang.replace("%", "%25").replace("\t", "%09")


def suffixes(docs: DataFrame, hot: dict[str, dict[str, int]], max_n: int = MAX_N) -> DataFrame:
    """(key, n): key is `parts<tab>lang<tab>word<tab>word<tab>..` of a suffix, parts being 1 or the parts of its first word in hot."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, most=STEP):
                doc, piece, code, words = tokens(texts_of(part))
                of, langs = _langs(part)
                many, v = len(code), len(words)
                if not many:
                    continue
                own, top = of[doc], len(langs)
                for d in range(max_n):
                    later = np.zeros(many, np.int64)  # 0: the piece has no word there
                    later[: many - d] = np.where(piece[d:] == piece[: many - d], code[d:] + 1, 0)
                    if top * (v + 1) >= 1 << 62:
                        found, own = np.unique(own, return_inverse=True)
                        top = len(found)
                    own, top = own * (v + 1) + later, top * (v + 1)
                _, at, n = np.unique(own, return_index=True, return_counts=True)
                # the languages' words that go to several parts
                first, parts = of[doc[at]] * v + code[at], np.ones(len(at), np.int64)
                for i, lang in enumerate(langs):
                    for word, k in shared.value.get(lang, {}).items():
                        x = pc.index(words, pa.scalar(word.encode(), pa.large_binary())).as_py()
                        if x >= 0:
                            parts[first == i * v + x] = k
                kinds, which = np.unique(parts * len(langs) + of[doc[at]], return_inverse=True)
                heads = pa.array([f"{k // len(langs)}\t{_escaped(langs[k % len(langs)])}\t".encode() for k in kinds.tolist()], pa.large_binary())
                ended = pa.concat_arrays([pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\t", pa.large_binary())), pa.array([b""], pa.large_binary())])
                columns = [heads.take(pa.array(which.ravel()))]
                for d in range(max_n):
                    there = np.minimum(at + d, many - 1)
                    columns.append(ended.take(pa.array(np.where((at + d < many) & (piece[there] == piece[at]), code[there], v))))
                key = pc.binary_join_element_wise(*columns, pa.scalar(b"", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([key.cast(pa.large_string()).cast(pa.string()), pa.array(n)], names=["key", "n"])

    return _rows(docs).mapInArrow(op, "key string, n bigint")


class Stack:
    """The open prefix of each depth, with its count so far; rows come sorted by key, largest first."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least, self.last = max_n, least, b""
        self.open: list[tuple[bytes, int] | None] = [None] * max_n

    def _wanted(self, prefix: bytes, depth: int, count: int) -> bool:
        return count >= self.least or depth < self.max_n and not prefix.startswith(b"1\t")

    def close(self, depth: int) -> list[tuple[bytes, int]]:
        """Pops the prefix of this depth; what it counted, unless too little."""
        own, self.open[depth - 1] = self.open[depth - 1], None
        return [own] if own and self._wanted(own[0], depth, own[1]) else []

    def push(self, keys: pa.Array, n: np.ndarray) -> list[tuple[bytes, int]]:
        """Counts further rows; the prefixes that they close."""
        m, ends = len(keys), np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        raw = keys.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if m else b""
        if not m:
            return []
        ends -= ends[0]
        data, size = np.frombuffer(raw, np.uint8), np.diff(ends)
        # where each word ends: the tabs of a key after those of the parts and the language
        tabs = np.flatnonzero(data == 9)
        before = np.searchsorted(tabs, ends)
        words = np.diff(before) - 2
        upto = np.full((m, self.max_n + 1), np.iinfo(np.int64).max)
        for d in range(1, self.max_n + 1):
            has = words >= d
            upto[has, d] = tabs[before[:-1][has] + 1 + d] + 1 - ends[:-1][has]
        # the words that each key shares with the one before it
        both = np.minimum(size[1:], size[:-1])
        starts = np.cumsum(both) - both
        index = np.arange(int(both.sum())) - np.repeat(starts, both)
        unlike = np.flatnonzero(data[np.repeat(ends[1:-1], both) + index] != data[np.repeat(ends[:-2], both) + index])
        row, alike = np.searchsorted(starts, unlike, "right") - 1, both.copy()
        # an empty overlap cannot be: all keys hold three tabs
        alike[row[::-1]] = (unlike - starts[row])[::-1]
        head = raw[: int(size[0])]
        same = next((i for i, (a, b) in enumerate(zip(head, self.last)) if a != b), min(len(head), len(self.last)))
        shared = (upto[:, 1:] <= np.append(same, alike)[:, None]).sum(1)
        total, out = np.concatenate([[0], np.cumsum(n)]), []
        for d in range(1, self.max_n + 1):
            cuts = np.flatnonzero(shared < d)
            if shared[0] >= d:
                prefix, count = self.open[d - 1]
                self.open[d - 1] = (prefix, count + int(total[cuts[0] if len(cuts) else m]))
            if not len(cuts):
                continue
            out += self.close(d)
            counts = np.diff(total[np.append(cuts, m)])
            a, b = ends[cuts], ends[cuts] + np.where(words[cuts] >= d, upto[cuts, d], 0)
            part = data[a] != 49 if d < self.max_n else np.zeros(len(cuts), bool)  # not "1": one of several parts, or a count of its own
            part |= (data[a + 1] != 9) if d < self.max_n else False
            for i in np.flatnonzero((b > a)[:-1] & ((counts >= self.least) | part)[:-1]).tolist():
                out.append((raw[a[i] : b[i]], int(counts[i])))
            if b[-1] > a[-1]:
                self.open[d - 1] = (raw[a[-1] : b[-1]], int(counts[-1]))
        self.last = raw[int(ends[-2]) :]
        return out


def dealt(docs: DataFrame, words: DataFrame, max_n: int = MAX_N, part_words: int = PART_WORDS) -> DataFrame:
    """The suffixes in their parts, each sorted by key, largest first; words: word_counts(docs)."""
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * max_n / part_words))
    hot: dict[str, dict[str, int]] = {}
    # at most 2 * parts words have so many suffixes
    for r in words.where(F.col("f") * (2 * parts) > total).collect():
        hot.setdefault(r["lang"], {})[r["word"]] = max(2, math.ceil(2 * parts * r["f"] / total))
    key, several = F.col("key"), ~F.col("key").startswith("1\t")
    own = F.when(several, F.pmod(F.xxhash64(key), F.substring_index(key, "\t", 1).cast("long"))).otherwise(F.lit(0))
    return suffixes(docs, hot, max_n).repartition(parts, F.substring_index(key, "\t", 3), own).sortWithinPartitions(key.desc())


def phrase_counts(docs: DataFrame, words: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, part_words: int = PART_WORDS) -> DataFrame:
    """(lang, words, k, f) of all phrases of 1 to max_n words found `least` times or more; words: word_counts(docs)."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([p.decode() for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["key", "f"])
        for batch in batches:
            yield batch_of(stack.push(batch.column(0), batch.column(1).to_numpy()))
        yield batch_of([x for d in range(1, max_n + 1) for x in stack.close(d)])

    # only prefixes of several parts have more than one row; all go the same way, so that nothing is written in between
    counted = dealt(docs, words, max_n, part_words).mapInArrow(op, "key string, f bigint").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    split = F.split("key", "\t")
    lang = F.replace(F.replace(F.get(split, 1), F.lit("%09"), F.lit("\t")), F.lit("%25"), F.lit("%"))
    return counted.select(lang.alias("lang"), F.slice(split, F.lit(3), F.size(split) - 3).alias("words"), (F.size(split) - 3).alias("k"), "f")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each lang, with their rank: of each of many shares, of each of some, then of all."""
    some = math.ceil(math.sqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    share = F.pmod(F.xxhash64("phrase"), F.lit(some * some))
    for keys in ([share], [F.pmod(share, F.lit(some))], []):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return rows


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, covered: int = COVERED, top: int = TOP, part_words: int = PART_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the `top` phrases of each lang.

    Phrases of 2 to max_n words found a >= least times in pieces of text. The score is the
    least, over the cuts in two parts found l and r times, of floor(10^6 a^2 / (l r)); of
    equal cuts the first. A phrase inside a longer one that is found covered % as often
    or more is left out. By score, a (largest first), then phrase. Null texts are empty,
    a null lang is `und`; rows with one doc_id count each; no words, no rows.
    """
    words = written(word_counts(docs), "words")
    counts = written(phrase_counts(docs, words, max_n, least, part_words), "phrases")
    long = counts.where("k > 1").select("lang", "words", "k", F.col("f").alias("a"))
    cuts = long.select("lang", _phrase(F.col("words")).alias("phrase"), "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", _phrase(F.slice("words", F.lit(1), F.col("cut")))).withColumn("right", _phrase(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))))
    part = lambda side, name: counts.select("lang", _phrase(F.col("words")).alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    score = F.expr("exact_a2 div exact_lr")
    cuts = cuts.withColumn("exact_a2", F.lit(1_000_000).cast("decimal(7,0)") * exact["a"] * exact["a"]).withColumn("exact_lr", exact["l"] * exact["r"]).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: _phrase(F.slice("words", at, size)))))
    inside = long.where("k > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True)))
    kept = written(kept.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", "worst.cut"), "scored")
    best = _first(kept, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    return best.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op11_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text")).drop("cut")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM split, (SELECT unnest([1, 2, 3]) AS k)
), f AS (
  SELECT lang, k, g, count(*) AS f, array_to_string(g, ' ') AS phrase FROM grams GROUP BY lang, k, g HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.g, c.f AS a, j.j, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM f c, (SELECT unnest([1, 2]) AS j) j, f l, f r
  WHERE c.k > 1 AND j.j < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.g = c.g[1:j.j] AND r.g = c.g[j.j + 1:c.k]
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM worst c WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.k = 3 AND c.k = 2 AND x.lang = c.lang AND (x.g[1:2] = c.g OR x.g[2:3] = c.g) AND 100 * x.f >= 50 * c.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
