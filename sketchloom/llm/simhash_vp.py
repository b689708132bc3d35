"""SimHash near-dedup (9): vantage-point trees over 64-bit fingerprints, exact pairs.

A full 64-bit Hamming ball of radius 4 overlaps nearly every shard of a tree over random
fingerprints (distances gather at 32 +- 4), so one tree cannot prune. Hamming distance
over a subset of the bits is a metric too: the bits are dealt to views so that a pair
within the radius lies within radius 1 in one view at least (pigeonhole). Each view has a
vantage-point tree. A fingerprint has one home leaf in each tree and, as a query, visits
each leaf that the triangle bound d(x, v) -+ 1 leaves possible. Within a leaf, a visitor
meets the homes that differ from it in one bit of the view at most, found by binary
search, and pairs are verified on all 64 bits: none is lost and none is wrong. With more
fingerprints views get longer, so the homes met stay few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_dedup
from .common import components, forest, read, texts_of, written

RADIUS = 4
#: Fingerprints up to which views are one, two and (beyond) three parts of the bits.
FEW, MANY = 1 << 24, 1 << 30
#: Fingerprints that the trees are fitted on, at most; the trees route all of them.
SAMPLE = 16_384
#: Fingerprints that a leaf should hold, and of a fitted leaf's own sample at least.
LEAF, LEAST_SAMPLE = 2048, 8
#: Fingerprints of a part of a leaf; parts with over twice as many are dealt in tiles of so many.
PART = 4096
#: Pairs that a comparison expands at once.
STEP = 1 << 21
_CHUNK = 1 << 16


def views_for(n: int, radius: int = RADIUS, bits: int = 64) -> list[tuple[int, int]]:
    """(mask, radius in the view) of each view for n fingerprints.

    The bits are cut in equal parts, and a view is each choice of 1, 2 or 3 of them. Of m
    parts, the s with the fewest differing bits differ in as many as an even spread gives.
    """
    parts, taken = (radius // 2 + 1, 1) if n <= FEW else (radius + 1, 2) if n <= MANY else (radius + 2, 3)
    cuts = np.linspace(0, bits, parts + 1).astype(int).tolist()
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    own = taken * (radius // parts) + max(0, taken - (parts - radius % parts))
    return [(sum(c), own) for c in combinations(masks, taken)]


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash: bit set if set in over half of the XXH64 (seed 42) of the shingles."""
    split = text.lower().split()  # both take ASCII only
    n = len(split)
    if not n:
        return 0
    joined, k = b" ".join(split), min(words, n)
    size = np.fromiter(map(len, split), np.int64, n)
    begin = np.cumsum(size + 1) - size - 1
    starts, ends = begin[: n - k + 1].tolist(), (begin + size)[k - 1 :].tolist()
    digest, many, votes = xxhash.xxh64_digest, n - k + 1, np.zeros(64, np.int64)
    for at in range(0, many, _CHUNK):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > many).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the 64 bits; a null or empty text has 0."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = texts_of(batch).cast(pa.large_binary())
                fp = np.fromiter((fingerprint(x.as_py(), words) for x in raw), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(op, "doc_id bigint, fp bigint")


@dataclass
class Tree:
    mask: np.uint64
    radius: int
    vantage: list  # of inner nodes
    cut: list
    kids: list  # (left, right): inner node >= 0, or leaf ~i
    leaves: int

    def route(self, x: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x that visit it); with radius 0, each row's home alone."""
        if not self.vantage:
            return [(0, np.arange(len(x)))]
        out, todo = [], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((~node, rows))
                continue
            d = np.bitwise_count((x[rows] ^ self.vantage[node]) & self.mask).astype(np.int64)
            left, right = self.kids[node]
            todo += [(left, rows[d - radius <= self.cut[node]]), (right, rows[d + radius > self.cut[node]])]
        return out


def grow(sample: np.ndarray, mask: int, radius: int, leaves: int, seed: int = 9) -> Tree:
    """A tree over a sample: the vantage points and cuts whose larger side, overlap included, is least."""
    rng, m = np.random.default_rng(seed), np.uint64(mask)
    tree = Tree(m, radius, [], [], [], 0)
    least = max(2, len(sample) // max(leaves, 1))

    def leaf() -> int:
        tree.leaves += 1
        return ~(tree.leaves - 1)

    def split(own: np.ndarray) -> int:
        if len(own) < 2 * least:
            return leaf()
        best = None
        for v in rng.choice(own, min(12, len(own)), replace=False):
            count = np.bincount(np.bitwise_count((own ^ v) & m), minlength=65).cumsum()
            for cut in range(64):
                l, r = count[min(cut + radius, 64)], len(own) - (count[cut - radius] if cut >= radius else 0)
                if count[cut] and count[cut] < len(own) and (best is None or max(l, r) < best[0]):
                    best = max(l, r), v, cut
        if best is None or best[0] > 0.95 * len(own):
            return leaf()
        node = len(tree.vantage)
        tree.vantage.append(best[1]), tree.cut.append(best[2]), tree.kids.append(None)
        d = np.bitwise_count((own ^ best[1]) & m)
        tree.kids[node] = split(own[d <= best[2]]), split(own[d > best[2]])
        return node

    split(sample)
    return tree


def plant(distinct: DataFrame, n: int, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> list[Tree]:
    """The trees of all views, fitted on at most `sample` of the n fingerprints, chosen by hash."""
    own = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sample).collect()], np.int64).view(np.uint64)
    leaves = max(1, min(n // leaf, len(own) // LEAST_SAMPLE))
    return [grow(own, mask, r, leaves) for mask, r in views_for(n, radius)]


def pieces_of(mask: int, radius: int) -> list[np.uint64]:
    """A view's bits in radius + 1 pieces: rows within the radius agree in one piece at least."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [np.uint64(sum(x)) for x in np.array_split(np.array(bits, object), radius + 1)]


def flips_of(mask: int, radius: int) -> list[int]:
    """All changes of up to `radius` bits of a view."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]


def links(distinct: DataFrame, trees: list[Tree], n: int, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(a, b): edges between the n fingerprints (fp) with the connectivity of all pairs within the radius.

    A leaf over `part` rows is dealt in parts by the value of a piece of the view's bits,
    once for each piece, so that rows are copied as often in a large leaf as in a small one.
    A part that still holds over twice as many goes to several tasks, in tiles of its homes
    and visitors. A task returns a spanning forest of its pairs, never all of them.
    """
    spark = distinct.sparkSession
    pieces = [pieces_of(int(t.mask), t.radius) for t in trees]
    parts = [-(-n // (max(t.leaves, 1) * part)) for t in trees]
    shared = spark.sparkContext.broadcast(trees)
    mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

    def routes(fp: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(view, leaf, home, rows, part of each row)"""
        for v, t in enumerate(shared.value):
            for home in (1, 0):
                for leaf, rows in t.route(fp, 0 if home else t.radius):
                    if parts[v] == 1:
                        yield v, leaf, home, rows, np.zeros(len(rows), np.int64)
                    else:
                        for i, bits in enumerate(pieces[v]):
                            yield v, leaf, home, rows, i * parts[v] + (mixed(fp[rows] & bits) % np.uint64(parts[v])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 5), np.int64)]
            for v, leaf, home, rows, own in routes(batch.column(0).to_numpy().view(np.uint64)):
                k, c = np.unique(own, return_counts=True)
                found.append(np.stack([np.full(len(k), v), np.full(len(k), leaf), k, c * home, c * (1 - home)], 1))
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1].astype(np.int32)), *(pa.array(x[:, j]) for j in (2, 3, 4))], names=["view", "leaf", "part", "homes", "visits"])

    sizes = distinct.select("fp").mapInArrow(count, "view int, leaf int, part bigint, homes bigint, visits bigint").groupBy("view", "leaf", "part").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
    # only parts that a group of alike fingerprints fills: at most one for each 2 * part rows
    hot = sizes.where((F.col("homes") > 2 * part) | (F.col("visits") > 4 * part)).collect()
    tiles = spark.sparkContext.broadcast({(r["view"], r["leaf"], r["part"]): (-(-r["homes"] // part) or 1, -(-r["visits"] // (2 * part)) or 1) for r in hot})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            spread = mixed(fp.view(np.uint64) ^ np.uint64(0x5DEECE66D)).astype(np.int64)
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]

            def add(v: int, leaf: int, own: np.ndarray, tile: np.ndarray, rows: np.ndarray, home: int) -> None:
                for c, x in zip(cols, (np.full(len(rows), v), np.full(len(rows), leaf), own, tile, fp[rows], np.full(len(rows), home))):  # noqa: B023
                    c.append(x)

            for v, leaf, home, rows, own in routes(fp.view(np.uint64)):
                split = [k for k in np.unique(own).tolist() if (v, leaf, k) in tiles.value] if tiles.value else []
                for k in split:
                    h, q = tiles.value[v, leaf, k]
                    some = rows[own == k]
                    for j in range(q if home else h):
                        add(v, leaf, np.full(len(some), k), spread[some] % h * q + j if home else j * q + spread[some] % q, some, home)
                plain = ~np.isin(own, split) if split else slice(None)
                add(v, leaf, own[plain], np.zeros(len(own[plain]), np.int64), rows[plain], home)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int64, np.int64, np.int64, bool))], names=["view", "leaf", "part", "tile", "fp", "home"])

    def compare(table: pa.Table) -> pa.Table:
        tree = shared.value[table.column("view")[0].as_py()]
        home = table.column("home").to_numpy()
        node = np.unique(table.column("fp").to_numpy())
        fp, label = node.view(np.uint64), np.arange(len(node))
        at = np.searchsorted(node, table.column("fp").to_numpy())
        h, q = np.unique(at[home]), np.unique(at[~home])
        h = h[np.argsort(fp[h] & tree.mask, kind="stable")]
        own, mine = fp[h] & tree.mask, fp[q] & tree.mask
        for flip in flips_of(int(tree.mask), tree.radius):
            lo, hi = (np.searchsorted(own, mine ^ np.uint64(flip), side) for side in ("left", "right"))
            ends = np.cumsum(hi - lo)
            for part_of in np.split(np.arange(len(q)), np.searchsorted(ends, np.arange(STEP, int(ends[-1]) if len(q) else 0, STEP))):
                many = (hi - lo)[part_of]
                if not many.sum():
                    continue
                a = np.repeat(q[part_of], many)
                b = h[np.repeat(lo[part_of] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                x = np.bitwise_count(fp[a] ^ fp[b])
                near = (x <= radius) & (x > 0)
                label = forest(label, a[near], b[near])
        k = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": node[k], "b": node[label[k]]})

    return distinct.select("fp").mapInArrow(deal, "view int, leaf int, part bigint, tile bigint, fp bigint, home boolean").groupBy("view", "leaf", "part", "tile").applyInArrow(compare, "a bigint, b bigint")


def classes(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text, ...).

    component_id: the least doc_id that links reach, the row's own included. Rows of one
    fingerprint are one node, so copies never make pairs. A null or empty text has
    fingerprint 0 and links like any other. Rows without a doc_id take part, but name no
    class: a class of such rows only has component_id null. Rows of one doc_id and several
    texts are several documents. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    reach = components(links(distinct.select("fp"), plant(distinct, n, radius), n, radius)).withColumnRenamed("node", "fp")
    of = distinct.join(reach, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of nodes (node, fp) that connect, through the trees, all nodes with fingerprints within the radius."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    n = heads.count()
    met = links(heads.select("fp"), plant(heads, n, radius), n, radius)
    first, second = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"node_{c}")) for c in "ab")
    far = met.join(first, "a").join(second, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).union(far)


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near copies: five-word shingles, Jaccard 0.8 or more, exact sets.

    The trees find the pairs of SimHashes within RADIUS bits, and shingle_dedup adds those
    at 0.8 whose 64-bit fingerprints differ in more. The row with the least doc_id stays
    (rows without one come last), then the one with the least text hash. Rows of one doc_id
    and several texts are several documents; a null text is an empty one. All columns of
    docs stay as they are.
    """
    return shingle_dedup.deduplicated(docs, near_pairs)


def op9_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
