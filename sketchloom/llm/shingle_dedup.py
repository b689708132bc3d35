"""Near copies by word shingles: classes of texts with a Jaccard similarity of 0.8 or more.

At this similarity two 64-bit SimHashes differ in about 10 bits, where no tree prunes, so
beside the pairs that the trees find, candidates are texts that agree in one of BANDS bands
of minima; a pair at 0.8 agrees in none with a chance of (1 - 0.8^ROWS)^BANDS = 3e-5. Every
link is verified on the exact shingle sets, or joins texts of one class.

First each text is compared with one other, then classes that meet in a band: texts that
share too few shingles with all others there leave, and the rest is compared in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, rowed, texts_of, unrowed, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
#: Texts of a tile, and columns of the 0/1 matrices that a tile multiplies.
TILE, COLUMNS = 512, 1 << 13
_CHUNK = 1 << 14
_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The XXH64 of the text's distinct shingles, ascending; a text of fewer words is one shingle."""
    split = text.lower().split()  # both take ASCII only
    n = len(split)
    if not n:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(split), min(SHINGLE, n)
    size = np.fromiter(map(len, split), np.int64, n)
    begin = np.cumsum(size + 1) - size - 1
    starts, ends = begin[: n - k + 1].tolist(), (begin + size)[k - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, n - k + 1))


def bands(own: np.ndarray) -> list[int]:
    """A key of each band; a text without words has the keys of its like."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _CHUNK):
        least = np.minimum(least, (_MULTIPLY[:, None] * own[None, at : at + _CHUNK] + _ADD[:, None]).min(1))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def simhash(own: np.ndarray) -> int:
    """64-bit SimHash of distinct shingles, each a vote."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(own), _CHUNK):
        votes += np.unpackbits(np.ascontiguousarray(own[at : at + _CHUNK], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(own)).tobytes(), "big", signed=True)


def node_of(text: Column) -> Column:
    """Equal texts are one node; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sets(texts: DataFrame, need: DataFrame, name: str) -> DataFrame:
    """(node, own) of the nodes in need: the shingles of each as bytes."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [shingles(x.as_py()).tobytes() for x in texts_of(batch).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    one = texts.join(need.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return written(one.mapInArrow(op, "node bigint, own binary"), name)


def _verified(texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are SIMILAR."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    found = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-sets")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first, second = (found.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")).hint("merge") for c in "ab")
    met = pairs.join(first, "a").join(second, "b").select("a", "b", "own_a", "own_b")
    return written(met.mapInArrow(similar, "a bigint, b bigint"), f"{name}-similar")


def _able(found: DataFrame) -> DataFrame:
    """(node, own) of texts that share enough shingles with others of found to be similar to one: lossless."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            many = np.array([len(x) for x in raw], np.int64)
            if many.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(np.concatenate(raw))], names=["node", "h"])

    alone = found.mapInArrow(op, "node bigint, h bigint").groupBy("h").agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    many = F.octet_length("own") / 8
    return found.join(alone.hint("merge"), "node", "left").where(many - F.coalesce("alone", F.lit(0)) >= SIMILAR * many).select("node", "own")


def _compared(rows: DataFrame) -> DataFrame:
    """(a, b): links that connect the similar texts of each key, of rows (key, node, component, own).

    Texts of one component are not compared. A key over TILE texts is dealt to several
    tasks, each with two tiles of them; a task returns a spanning forest of its links.
    """
    tiles = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count_distinct("component").alias("c")).where("c > 1").drop("c")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(F.col("tile"), j).alias("i"), F.greatest(F.col("tile"), j).alias("j")))
    dealt = rows.join(tiles.hint("merge"), "key").withColumn("tile", own).select("key", F.explode(every).alias("at"), "tile", "node", "component", "own")

    def op(table: pa.Table) -> pa.Table:
        tile, node, component = (table.column(c).to_numpy() for c in ("tile", "node", "component"))
        own = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("own")]
        size = np.array([len(x) for x in own], np.int64)
        values, column, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
        doc = np.repeat(np.arange(len(own)), size)
        doc, place = doc[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        doc, place = doc[order], place[order]
        a, b = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
        both = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            s = slice(*np.searchsorted(place, (low, low + COLUMNS)))
            x = np.zeros((len(own), min(COLUMNS, int(place[-1]) + 1 - low)), np.float32)
            x[doc[s], place[s] - low] = 1
            both += x[a] @ x[b].T
        near = both.astype(float) >= SIMILAR * (size[a][:, None] + size[b][None, :] - both.astype(float))
        near &= component[a][:, None] != component[b][None, :]
        x, y = np.nonzero(near)
        label = forest(np.arange(len(own)), a[x], b[y])
        k = np.flatnonzero(label != np.arange(len(own)))
        return pa.table({"a": node[k], "b": node[label[k]]})

    return dealt.select("key", "at.i", "at.j", "tile", "node", "component", "own").groupBy("key", "i", "j").applyInArrow(op, "a bigint, b bigint")


def near_copies(docs: DataFrame, near_pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the texts that have near copies; the least node names a class.

    near_pairs gives first pairs (a, b) for texts (node, fp), fp being their SimHash.
    """
    texts = docs.select(node_of(F.col("text")).alias("node"), "text")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [shingles(x.as_py()) for x in texts_of(batch).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([simhash(x) for x in own], pa.int64()), pa.array([bands(x) for x in own], pa.list_(pa.int64()))], names=["node", "many", "fp", "keys"])

    rows = texts.mapInArrow(op, "node bigint, many bigint, fp bigint, keys array<bigint>").groupBy("node").agg(*[F.first(c).alias(c) for c in ("many", "fp", "keys")])
    rows = written(rows, "bands")
    banded = rows.select("node", "many", F.explode("keys").alias("key"))
    alike = F.least("many", "other_many") >= SIMILAR * F.greatest("many", "other_many")
    # each text with one head of its bands: enough to join most classes
    heads = banded.groupBy("key").agg(F.min_by(F.struct("node", "many"), "node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", F.col("head.node").alias("other"), F.col("head.many").alias("other_many"))
    stars = banded.join(heads.hint("merge"), "key").where(F.col("node") != F.col("other")).where(alike).groupBy("node").agg(F.min("other").alias("other")).select(F.col("node").alias("a"), F.col("other").alias("b"))
    edges = _verified(texts, stars.union(near_pairs(rows.select("node", "fp"))) if near_pairs else stars, "first")
    # then the texts of a band that lie in several classes
    reach = components(edges)
    banded = written(banded.join(reach.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "classed")
    mixed = banded.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    mixed = written(banded.join(mixed.hint("merge"), "key", "left_semi"), "mixed")
    able = written(_able(_sets(texts, mixed.select("node").distinct(), "mixed-sets")), "able")
    return components(edges.union(written(_compared(mixed.join(able.hint("merge"), "node")), "rest")))


def deduplicated(docs: DataFrame, near_pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with one row of each class: that of its least doc_id (none comes last), then least text hash.

    A second hash tells apart texts that share a node by chance: only equal ones are then copies.
    """
    other = F.xxhash64(F.lit(1), F.coalesce(F.col("text"), F.lit("")))
    rows = rowed(docs, _id=F.col("doc_id"), _node=node_of(F.col("text")), _other=other)
    reach = near_copies(docs, near_pairs).withColumnRenamed("node", "_node")
    of = docs.select(F.col("doc_id").alias("_id"), node_of(F.col("text")).alias("_node"), other.alias("_other")).groupBy("_node", "_other").agg(F.min(F.struct(F.col("_id").isNull(), "_id")).alias("k"))
    one = of.groupBy("_node").agg(F.min("_other").alias("x"), F.max("_other").alias("y")).select("_node", (F.col("x") != F.col("y")).alias("_shared"))
    of = of.join(one.hint("merge"), "_node").join(reach.hint("merge"), "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    keep = of.groupBy("component", F.when(F.col("_shared"), F.struct("_node", "_other")).alias("own")).agg(F.min(F.struct("k", "_node", "_other")).alias("k")).select(F.col("k.k._id").alias("_keep_id"), F.col("k._node").alias("_keep"), F.col("k._other").alias("_keep_other"))
    got = rows.join(keep.hint("merge"), (F.col("_node") == F.col("_keep")) & (F.col("_other") == F.col("_keep_other")) & F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi")
    return got.dropDuplicates(["_node", "_other", "_id"]).select(*unrowed(docs.columns))
