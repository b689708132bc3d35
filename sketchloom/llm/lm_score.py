"""LM scoring (5): cross-entropy difference of two n-gram models.

A target model (documents labelled good) and a background model (all documents) share one
vocabulary: every word of the corpus. Both are interpolated bigram models; a document's
score is the mean over its words of the background's loss less the target's (higher: more
like the target).

Words and bigrams are counted under 64-bit hashes, so vocabulary and counts grow with the
corpus. Texts are coded once, in chunks: each chunk sends its distinct words and bigrams
with their own counts to the task that a hash belongs to and gets back the corpus's counts
of just these (cross_entropy()). With more than FAN chunks or parts they go by tasks in between,
which add up what a group of chunks sends to a range of parts: a row always holds many n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read, steps, texts_of, word_ids, written

#: Weight of the bigram estimate, and the count that smooths each unigram.
MIX, PRIOR = 0.6, 0.1
#: Text bytes of a chunk, and distinct n-grams that a counting task should get of all chunks.
CHUNK_BYTES, PART = 16 << 20, 1 << 20
#: Rows that a chunk, or a task on the way, sends and receives at most (about).
FAN = 4096
_START_KEY = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty


def packed(keys: np.ndarray, ordered: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; ascending ones as their steps."""
    a = np.ascontiguousarray(keys, "<u8")
    if ordered:
        a = np.diff(a, prepend=np.uint64(0))
    return pa.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    a = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(a, dtype=np.uint64) if ordered else a


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bigrams of words with these hashes."""
    k = first * np.uint64(0x9E3779B97F4A7C15) + second
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ (k >> np.uint64(33))) * np.uint64(c)
    return k ^ (k >> np.uint64(33))


def chunks(docs: DataFrame) -> DataFrame:
    """The texts in chunks: (chunk, doc_id, n, distinct, words, ids).

    words: the hashes of the chunk's distinct lower-cased words and of the start of a text,
    ascending; ids: each word's place in them, n[i] of document i.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, most=CHUNK_BYTES):
                offsets, ids, words = word_ids(texts_of(part))
                lowered = pc.utf8_lower(words).cast(pa.large_binary()).to_pylist()
                keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in lowered), np.uint64, len(lowered))
                own, place = np.unique(np.append(keys, _START_KEY), return_inverse=True)
                cols = [pa.array([x], t) for x, t in ((part.column(0).to_pylist(), pa.list_(pa.int64())), (np.diff(offsets).tolist(), pa.list_(pa.int64())), (len(own), pa.int64()), (packed(own, True), pa.binary()), (packed(place[ids]), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "distinct", "words", "ids"])

    coded = docs.select("doc_id", "text").mapInArrow(op, "doc_id array<bigint>, n array<bigint>, distinct bigint, words binary, ids binary")
    return written(coded.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


class Chunk:
    """A row of chunks() with its distinct bigrams, in the order of their hashes."""

    def __init__(self, table: pa.Table) -> None:
        row = {c: table.column(c)[0].as_py() for c in ("chunk", "doc_id", "n", "distinct", "words", "ids")}
        self.chunk, self.doc_id, self.n = row["chunk"], row["doc_id"], np.array(row["n"], np.int64)
        self.words = unpacked(row["words"], row["distinct"], True)
        self.ids = unpacked(row["ids"], int(self.n.sum())).astype(np.int64)
        offsets, self.start = np.append(0, self.n.cumsum()), int(np.searchsorted(self.words, _START_KEY))
        first = np.empty_like(self.ids)
        first[1:] = self.ids[:-1]
        first[offsets[:-1][self.n > 0]] = self.start
        codes, pair = np.unique(first * len(self.words) + self.ids, return_inverse=True)
        first, second = np.divmod(codes, len(self.words))
        keys = pair_keys(self.words[first], self.words[second])
        order = keys.argsort(kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        #: hash, first and second word of each distinct bigram, and the bigram at each word
        self.keys, self.first, self.second, self.pair = keys[order], first[order], second[order], back[pair]

    def counts(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and bigrams of the documents that are on."""
        at = np.repeat(on, self.n)
        words = np.bincount(self.ids[at], minlength=len(self.words))
        words[self.start] = (self.n[on] > 0).sum()
        return words, np.bincount(self.pair[at], minlength=len(self.keys))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Route:
    """The way of n-grams from chunks to the parts of their hashes, in `levels` steps.

    A node of level l adds up what fan^l chunks (a group) send to a range of fan^(levels - l)
    parts; those of the last level are the parts. Within what one sender sends, nodes ascend with the hashes.
    """

    def __init__(self, chunks: int, parts: tuple[int, int], fan: int) -> None:
        self.chunks, self.parts, self.fan, self.levels = max(chunks, 1), parts, fan, 1
        while fan**self.levels < max(self.chunks, *parts):
            self.levels += 1

    def first(self, chunk: int) -> int:
        """The place of a chunk among all, by its hash."""
        return xxhash.xxh64_intdigest(chunk.to_bytes(8, "little")) % self.chunks

    def groups(self, level: int) -> int:
        return -(-self.chunks // self.fan**level)

    def below(self, node: int, level: int) -> tuple[int, int]:
        """(kind, group) of a node: words are of kind 0, bigrams of kind 1."""
        kind, place = divmod(node, 1 << 61)
        return kind, place % self.groups(level)

    def split(self, keys: np.ndarray, kind: int, group: int, level: int) -> Iterator[tuple[int, slice]]:
        """(node of this level, its keys) of ascending keys from a group of the level below."""
        span = part_of(keys, self.parts[kind]) // self.fan ** (self.levels - level)
        cuts = [0, *(np.flatnonzero(np.diff(span)) + 1).tolist(), len(keys)]
        return (((kind << 61) + int(span[a]) * self.groups(level) + group // self.fan, slice(a, b)) for a, b in zip(cuts, cuts[1:]) if a < b)


#: What a chunk or node asks a node, and what it hears.
_ASKED = {"node": pa.int64(), "child": pa.int64(), "many": pa.int64(), "keys": pa.binary(), "target": pa.binary(), "background": pa.binary()}
_TOLD = {c: _ASKED[c] for c in ("child", "node", "many", "target", "background")}
_ASKED_TYPE, _TOLD_TYPE = (", ".join(f"{c} {'binary' if t == pa.binary() else 'bigint'}" for c, t in x.items()) for x in (_ASKED, _TOLD))


def _sent(rows: list[tuple]) -> pa.Table:
    """Rows of _ASKED."""
    return pa.table({c: pa.array(x, t) for (c, t), x in zip(_ASKED.items(), zip(*rows) if rows else [[]] * len(_ASKED))})


class Merged:
    """What a node was asked: the different keys, and for each row its place in them."""

    def __init__(self, table: pa.Table) -> None:
        self.table, self.many = table, table.column("many").to_pylist()
        self.keys, self.place = np.unique(np.concatenate([unpacked(x, n, True) for n, x in zip(self.many, table.column("keys").to_pylist())]), return_inverse=True)

    def total(self, name: str) -> np.ndarray:
        own = np.concatenate([unpacked(x, n) for n, x in zip(self.many, self.table.column(name).to_pylist())])
        return np.bincount(self.place, own, len(self.keys)).astype(np.int64)

    def answers(self, counts: dict[str, np.ndarray]) -> pa.Table:
        """Rows of _TOLD: each asker's share of the counts by key."""
        cuts = np.append(0, np.cumsum(self.many)).tolist()
        out = {c: self.table.column(c) for c in ("child", "node", "many")}
        return pa.table(out | {c: pa.array([packed(x[self.place[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for c, x in counts.items()})


def _heard(told: pa.Table, name: str) -> np.ndarray:
    """The counts that all nodes told, by the asker's keys; told is sorted by node."""
    return np.concatenate([unpacked(x, n) for n, x in zip(told.column("many").to_pylist(), told.column(name).to_pylist())])


def cross_entropy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row; losses are nats a word.

    The models count the documents themselves: all of them, and those labelled good outside
    the held-out fifth. score = background_loss - target_loss. A null or empty text has no
    words, losses of 0 and score 0. Repeated rows count and score each; an empty table gives
    no rows.
    """
    good = labels.where((F.col("quality") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    coded = chunks(docs)
    rows = coded.select("chunk", F.posexplode("doc_id").alias("at", "doc_id"), "n").select("chunk", "at", "doc_id", F.get("n", "at").alias("n"))
    # labels grow with the documents: one plan at every size, never a broadcast of them
    told = written(rows.where("doc_id is not null").join(good.hint("merge"), "doc_id").select("chunk", "at", "n"), "good")
    target = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = coded.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.count("*")).first()
    total, route = (target, sizes[0]), Route(sizes[2], (-(-sizes[1] // PART) or 1, -(-sizes[0] // PART) or 1), FAN)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, many, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys = unpacked(raw, many, True)
                yield from _sent([(node, chunk, at.stop - at.start, packed(keys[at], True), None, None) for node, at in route.split(keys, 0, route.first(chunk), 1)]).to_batches()

    def ask(one: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if one.num_rows:
            c = Chunk(one)
            is_good = np.zeros(len(c.n), bool)
            is_good[told.column("at").to_numpy()] = True
            counts = c.counts(is_good), c.counts(np.ones(len(c.n), bool))
            for kind, keys in enumerate((c.words, c.keys)):
                for node, at in route.split(keys, kind, route.first(c.chunk), 1):
                    rows.append((node, c.chunk, at.stop - at.start, packed(keys[at], True), *[packed(x[kind][at]) for x in counts]))
        return _sent(rows)

    def ahead(asked: DataFrame, level: int, counted: bool) -> DataFrame:
        """What the nodes of a level ask those of the next, with their sums of the counts if there are any."""

        def op(table: pa.Table) -> pa.Table:
            got, node = Merged(table), table.column("node")[0].as_py()
            kind, group = route.below(node, level)
            sums = [got.total(c) for c in ("target", "background")] if counted else []
            return _sent([(to, node, at.stop - at.start, packed(got.keys[at], True), *([packed(x[at]) for x in sums] or [None, None])) for to, at in route.split(got.keys, kind, group, level + 1)])

        return asked.groupBy("node").applyInArrow(op, _ASKED_TYPE)

    def different(table: pa.Table) -> pa.Table:
        return pa.table({"words": pa.array([len(Merged(table).keys)], pa.int64())})

    def answer(table: pa.Table) -> pa.Table:
        got = Merged(table)
        return got.answers({c: got.total(c) for c in ("target", "background")})

    def pass_on(asked: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("node")
        return Merged(asked).answers({c: _heard(told, c) for c in ("target", "background")})

    # the vocabulary: different words of the corpus, less the start of a text, and one more for any other
    found = coded.select("chunk", "distinct", "words").mapInArrow(words_of, _ASKED_TYPE)
    for level in range(1, route.levels):
        found = ahead(found, level, False)
    vocabulary = found.groupBy("node").applyInArrow(different, "words bigint").agg(F.coalesce(F.sum("words"), F.lit(1))).first()[0]

    def score(one: pa.Table, told: pa.Table) -> pa.Table:
        out = [pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)]
        if one.num_rows:
            c, told = Chunk(one), told.sort_by("node")
            doc, loss = np.repeat(np.arange(len(c.n)), c.n), []
            for k, name in enumerate(("target", "background")):
                got = _heard(told, name).astype(float)
                words, pairs = got[: len(c.words)], got[len(c.words) :]
                uni = (words + PRIOR) / (total[k] + PRIOR * vocabulary)
                history = words[c.first]
                p = np.where(history > 0, MIX * pairs / np.maximum(history, 1), 0) + np.where(history > 0, 1 - MIX, 1) * uni[c.second]
                loss.append(np.bincount(doc, -np.log(p)[c.pair], len(c.n)) / np.maximum(c.n, 1))
            out = [pa.array(c.doc_id, pa.int64()), pa.array(c.n), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[1] - loss[0])]
        return pa.table(dict(zip(("doc_id", "n_words", "target_loss", "background_loss", "score"), out)))

    by = coded.groupBy("chunk")
    asked = [by.cogroup(told.select("chunk", "at").groupBy("chunk")).applyInArrow(ask, _ASKED_TYPE)]
    for level in range(1, route.levels):
        asked[-1] = written(asked[-1], "asked")  # read on the way there and back
        asked.append(ahead(asked[-1], level, True))
    answered = asked.pop().groupBy("node").applyInArrow(answer, _TOLD_TYPE)
    while asked:
        answered = asked.pop().groupBy("node").cogroup(answered.groupBy("child")).applyInArrow(pass_on, _TOLD_TYPE)
    return by.cogroup(answered.groupBy("child")).applyInArrow(score, "doc_id bigint, n_words bigint, target_loss double, background_loss double, score double")


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
