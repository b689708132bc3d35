"""Products of sparse rows: what pairs of rows share, without a hash's rows squared on one key.

Where a join on the hash makes a bounded number of pairs for each entry it reads, and no hash
has too many rows for a task, that join is all. Otherwise it meets the hashes that few rows
hold, and the rows of the others are dealt to blocks: a task multiplies two blocks in numpy,
gets each entry once and returns one sum a pair, however many hashes the pair shares.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows of a block, and columns that a task multiplies at once.
BLOCK, COLUMNS = 1024, 4096
#: A hash in up to so many rows (or so many blocks, if they are more and under MOST) is met by a join.
RARE, MOST = 256, 2048
#: Pairs for each entry up to which one join on the hash is taken for all hashes of up to MOST rows.
JOINED = 16


def _block_product(table: pa.Table) -> pa.Table:
    """(a, b, n, g) of the pairs of rows of two blocks that share a hash; rows (a or b, e), e being the entries (h, w) of a row."""
    table = table.combine_chunks()
    left, lists = np.asarray(table.column("left")), table.column("e").combine_chunks()
    many = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = lists.flatten()
    hashes, column = np.unique(flat.field("h").to_numpy(), return_inverse=True)
    place, of, w = np.cumsum(left) - 1, np.repeat(np.arange(len(left)), many), flat.field("w").to_numpy()
    place = np.where(left, place, np.cumsum(~left) - 1)
    sides = []
    for on, name in ((left, "a"), (~left, "b")):
        sides.append((place[of[on[of]]], table.column(name).combine_chunks().filter(pa.array(on)), column[on[of]], w[on[of]]))
    (a, rows_a, ca, wa), (b, rows_b, cb, wb) = sides
    both, total = np.zeros((len(rows_a), len(rows_b))), np.zeros((len(rows_a), len(rows_b)))
    for low in range(0, len(hashes), COLUMNS):
        size = min(COLUMNS, len(hashes) - low)
        x, y = np.zeros((len(rows_a), size)), np.zeros((len(rows_b), size))
        one, two = (ca >= low) & (ca < low + size), (cb >= low) & (cb < low + size)
        x[a[one], ca[one] - low], y[b[two], cb[two] - low] = wa[one], wb[two]
        total += x @ y.T
        x[a[one], ca[one] - low], y[b[two], cb[two] - low] = 1, 1
        both += x @ y.T
    i, j = np.nonzero(both)
    return pa.table({"a": rows_a.take(pa.array(i)), "b": rows_b.take(pa.array(j)), "n": both[i, j].astype(np.int64), "g": total[i, j]})


def products(a: DataFrame, b: DataFrame | None = None, diagonal: bool = False, rare: int | None = None) -> DataFrame:
    """(a, b, n, g) of pairs of rows that share a hash: how many, and the sum of the products of their weights.

    a, b: (row, h) with each hash once a row, and w (1 if there is none). Without b, each
    pair of rows of a once, the lesser first, and with `diagonal` each row with itself. Exact.
    """
    own = b is None
    sides = [x.select("row", "h", (F.col("w").cast("double") if "w" in x.columns else F.lit(1.0)).alias("w")) for x in ([a] if own else [a, b])]
    each = reduce(DataFrame.union, (x.select("h", *[F.lit(int(i == j)).alias(f"n{j}") for j in range(len(sides))]) for i, x in enumerate(sides)))
    held = each.groupBy("h").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(sides))])
    held = held.withColumn("n1", F.col("n0")) if own else held.where("n0 > 0 and n1 > 0")
    meets = F.lit(diagonal or not own) | (F.col("n0") > 1)
    pairs = F.when(meets, F.col("n0") * F.col("n1"))
    largest, whole, entries = held.agg(F.coalesce(F.max(pairs), F.lit(0)), F.coalesce(F.sum(pairs.cast("double")), F.lit(0.0)), F.coalesce(F.sum(F.col("n0") if own else F.col("n0") + F.col("n1")), F.lit(0))).first()
    ordered = F.col("a") <= F.col("b") if diagonal else F.col("a") < F.col("b")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        one, two = (x.select("h", F.col("row").alias(n), F.col("w").alias(f"w{n}")) for x, n in ((a, "a"), (b, "b")))
        rows = one.join(two, "h")
        return (rows.where(ordered) if own else rows).groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("wa") * F.col("wb")).alias("g"))

    few = rare or RARE
    if largest <= few * few or (not rare and largest <= MOST * MOST and whole <= JOINED * entries):
        return met(sides[0], sides[-1])
    # the entries that meet another, with the pairs that their hash makes
    sides = [written(x.join(held.where(meets).select("h", pairs.alias("pairs")), "h"), "entries") for x in sides]
    a, b = sides[0], sides[-1]
    blocks = [max(1, -(-x.select("row").distinct().count() // BLOCK)) for x in sides]
    few = rare or min(max(RARE, *blocks), MOST)
    many = F.col("pairs") > few * few
    low = met(a.where(~many), b.where(~many))
    # the other hashes, tile by tile
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = [x.schema["row"].dataType.simpleString() for x in (a, b)]
    a, b = (x.where(many).groupBy("row").agg(F.collect_list(F.struct("h", "w")).alias("e")) for x in (a, b))
    left = a.select(of("row", blocks[0]).alias("i"), every(blocks[-1]).alias("j"), F.lit(True).alias("left"), F.col("row").alias("a"), F.lit(None).cast(kinds[1]).alias("b"), "e")
    right = b.select(every(blocks[0]).alias("i"), of("row", blocks[-1]).alias("j"), F.lit(False).alias("left"), F.lit(None).cast(kinds[0]).alias("a"), F.col("row").alias("b"), "e")
    tiles = left.union(right)
    tiled = (tiles.where("i <= j") if own else tiles).groupBy("i", "j").applyInArrow(_block_product, f"a {kinds[0]}, b {kinds[1]}, n bigint, g double")
    if own:  # a tile of one block holds each pair in both orders, one of two blocks in one
        alone = of("a", blocks[0]) == of("b", blocks[0])
        tiled = tiled.where(ordered | ~alone).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "g")
    return low.union(tiled).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
