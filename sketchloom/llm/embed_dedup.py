"""Embedding near-dedup (7): an inverted multi-index over vector halves.

Two independent codebooks, one for each half of the unit vectors, make a product grid of
cells. Every vector has one home cell; as a query it visits the cells in the order of the
sum of the two half distances (the multi-sequence order) until enough of them for the
target recall, and the pairs that meet are verified by the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, spanning, written

COSINE = 0.9
#: Vectors that the codebooks and the number of visits are fitted on, at most; all are indexed.
SAMPLE = 20_000
#: Share of the sample's made-up neighbours, just as near as COSINE or nearer, that visits must reach.
TARGET_RECALL = 0.98
MOST_CENTRES = 256
TILE = 2048
SEED = 7


@dataclass
class Index:
    left: np.ndarray  # (K, half)
    right: np.ndarray
    visits: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        far = lambda a, c: (a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1)[None, :]
        return far(x[:, :h], self.left), far(x[:, h:], self.right)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def order(self, x: np.ndarray, many: int) -> np.ndarray:
        """The first `many` cells of each row's multi-sequence.

        The n-th cell of the sequence has ranks i, j in the two half orders with
        (i + 1)(j + 1) <= n: these few are summed and sorted instead of a heap's walk.
        """
        a, b = self.halves(x)
        k = a.shape[1], b.shape[1]
        many = min(many, k[0] * k[1])
        if many == k[0] * k[1]:  # all cells
            return (a[:, :, None] + b[:, None, :]).reshape(len(x), -1).argsort(1, kind="stable")
        oa, ob = a.argsort(1, kind="stable")[:, :many], b.argsort(1, kind="stable")[:, :many]
        i = np.repeat(np.arange(oa.shape[1]), [min(many // (i + 1), ob.shape[1]) for i in range(oa.shape[1])])
        j = np.concatenate([np.arange(min(many // (i + 1), ob.shape[1])) for i in range(oa.shape[1])])
        total = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        top = total.argsort(1, kind="stable")[:, :many]
        rows = np.arange(len(x))[:, None]
        return oa[rows, i[top]] * k[1] + ob[rows, j[top]]


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means centres, k at most."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        many = np.bincount(near, minlength=len(c))
        c = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1) / np.maximum(many, 1)[:, None]
        c[many == 0] = x[rng.choice(len(x), int((many == 0).sum()))]
    return c


def fit(x: np.ndarray, n: int, cosine: float = COSINE, target: float = TARGET_RECALL) -> Index:
    """An index for n unit vectors, fitted on the sample x of them.

    About sqrt(n) cells, so a visit meets about sqrt(n) vectors. The visits are the
    fewest that reach `target` of the neighbours made by turning sample vectors in random
    directions to cosines between the threshold and 1.
    """
    rng = np.random.default_rng(SEED)
    k = int(np.clip(np.ceil(n**0.25), 2, MOST_CENTRES))
    h = x.shape[1] // 2
    index = Index(_centres(x[:, :h], k, rng), _centres(x[:, h:], k, rng), 1)
    own = x[rng.choice(len(x), 2000, replace=len(x) < 2000)]
    side = rng.normal(size=own.shape)
    side -= (side * own).sum(1, keepdims=True) * own
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    c = rng.uniform(cosine, 1, (len(own), 1))
    home = index.home(own * c + side * np.sqrt(1 - c * c))
    most = 128
    while True:  # ever more of the sequence, until enough of the neighbours are met
        step = max(1, (1 << 22) // most)
        met = [index.order(own[a : a + step], most) == home[a : a + step, None] for a in range(0, len(own), step)]
        rank = np.concatenate([np.where(m.any(1), m.argmax(1), most) for m in met])
        index.visits = int(np.quantile(rank, target, method="higher")) + 1
        if index.visits <= min(most, k * k):
            return index
        most *= 4


def usable(e: Column) -> Column:
    """Whether a vector can link: no null or non-finite component, not zero."""
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda v: v != 0)


def links(vectors: DataFrame, index: Index, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of (id, embedding, copies): links of each id, and edges (a, b) that connect what links connect.

    A pair counts once for each side: for the visitor where it is met, and for the home
    vector there too if that one does not visit the visitor's home itself. A cell over
    TILE rows is dealt to several tasks.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                for home, cells in ((0, shared.value.order(x, shared.value.visits)), (1, shared.value.home(x))):
                    for cell, n in zip(*np.unique(cells, return_counts=True)):
                        total.setdefault(int(cell), [0, 0])[home] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())], names=["cell", "homes", "visits"])

    # one row a cell: MOST_CENTRES squared at most
    sizes = vectors.select("id", "embedding").mapInArrow(count, "cell int, homes bigint, visits bigint").groupBy("cell").agg(F.sum("homes"), F.sum("visits")).collect()
    tiles = spark.sparkContext.broadcast({c: (-(-h // TILE), max(1, -(-q // (4 * TILE)))) for c, h, q in sizes if h})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch.slice(a, 2048) for a in range(0, batch.num_rows, 2048)]:
                x, ids = matrix(part), part.column(0).to_numpy()
                order, home = shared.value.order(x, shared.value.visits), shared.value.home(x)
                spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
                rows, cell, tile, is_home = [], [], [], []
                for r in range(len(ids)):
                    h, q = tiles.value[int(home[r])]
                    for j in range(q):
                        rows.append(r), cell.append(home[r]), tile.append(spread[r] % h * q + j), is_home.append(True)
                    for c in order[r]:
                        if int(c) in tiles.value:
                            h, q = tiles.value[int(c)]
                            for i in range(h):
                                rows.append(r), cell.append(c), tile.append(i * q + spread[r] % q), is_home.append(False)
                at = pa.array(rows, pa.int64())
                # only a home is asked which cells it visits itself
                seen = pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())).take(pa.array(rows, pa.int64(), mask=~np.array(is_home)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cell, np.int32)), pa.array(np.array(tile, np.int32)), pa.array(is_home), pa.array(home[rows].astype(np.int32)), seen, part.column(0).take(at), part.column(1).take(at), part.column(2).take(at)], names=["cell", "tile", "is_home", "home", "seen", "id", "embedding", "copies"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_home, home, ids, copies = (table.column(c).to_numpy() for c in ("is_home", "home", "id", "copies"))
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        h, q = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        seen = table.column("seen").combine_chunks().flatten().to_numpy().reshape(len(h), -1)
        total = np.zeros(len(ids), np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cell in np.unique(home[q]):
            own = q[home[q] == cell]
            back = (seen == cell).any(1)  # these visit the visitors' home themselves
            for at in range(0, len(own), 512):
                part = own[at : at + 512]
                near = (x[part] @ x[h].T >= cosine) & (ids[part][:, None] != ids[h][None, :])
                if near.any():
                    total[part] += near @ copies[h]
                    total[h] += np.where(back, 0, copies[part] @ near)
                    for c, e in zip((a, b), spanning(near, ids[part], ids[h])):
                        c.append(e)
        pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=1), axis=0)
        got = np.flatnonzero(total)
        n = len(pairs) + len(got)
        return pa.table({"id": np.concatenate([pairs[:, 0], ids[got]]), "other": pa.array(np.concatenate([pairs[:, 1], np.zeros(len(got), np.int64)]), mask=np.arange(n) >= len(pairs)), "n": np.concatenate([np.zeros(len(pairs), np.int64), total[got]])})

    kind = vectors.schema["embedding"].dataType.simpleString()
    dealt = vectors.select("id", "embedding", "copies").mapInArrow(deal, f"cell int, tile int, is_home boolean, home int, seen array<int>, id bigint, embedding {kind}, copies bigint")
    met = written(dealt.groupBy("cell", "tile").applyInArrow(compare, "id bigint, other bigint, n bigint"), "met")
    return met.where("other is null").groupBy("id").agg(F.sum("n").alias("n")), met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of one length are indexed and compared among themselves. Equal vectors
    are one vector with copies and link with each other; rows of one vec_id are rows of
    their own (each counts the others). Rows without a vec_id link too, but name no
    component. An empty table gives no rows.
    """
    # floats travel as floats; a comparison makes them doubles
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("embedding"))
    good = F.coalesce(usable(F.col("embedding")), F.lit(False))
    out = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = rows.where(good).select(F.size("embedding")).distinct().collect()  # one index for each length: few
    for dims in sorted(r[0] for r in lengths):
        out = out.unionByName(_of_length(rows.where(good & (F.size("embedding") == dims)), dims, cosine, sample))
    return out


def _of_length(rows: DataFrame, dims: int, cosine: float, sample: int) -> DataFrame:
    # equal vectors: one row; its number is a place in a table that stays as written
    groups = written(rows.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "vectors")
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "numbered")
    own = groups.orderBy(F.xxhash64("embedding"), "least").select("embedding").limit(sample)
    x = np.array([r[0] for r in own.collect()], float).reshape(-1, dims)
    index = fit(x / np.linalg.norm(x, axis=1, keepdims=True), groups.count(), cosine)
    counts, edges = links(groups, index, cosine)
    reach = components(edges).withColumnRenamed("node", "id")
    of = groups.join(reach, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").join(counts, "id", "left").select("embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(of, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
