"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_folder, new_folder, read, ship, written  # noqa: F401  (for the operators)

#: ASCII white space, as a regular-expression class body and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\f\r"
WORD = rf"[^{WS_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that one vectorised step takes at once.
STEP_BYTES = 2 << 20


def rowed(docs: DataFrame, **parts: Column) -> DataFrame:
    """docs as one struct column, _row, beside the named columns: no name of docs can clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in parts.items()])


def unrowed(names: list[str]) -> list[Column]:
    """The columns of rowed(), by name."""
    return [F.col(f"_row.`{c}`").alias(c) for c in names]


def beside(docs: DataFrame, *own: str) -> tuple[list[Column], Callable[[str], Column]]:
    """How to carry docs with the columns `own` at the top: the rest as one struct, _rest (none: no column), and each column's way back by name."""
    others = [c for c in docs.columns if c.lower() not in own]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []
    return rest, lambda c: (F.col(c.lower()) if c.lower() in own else F.col(f"_rest.`{c}`")).alias(c)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(sizes: Column, step: int = 128) -> Column:
    """The sum of the numbers before each place of an array, by blocks of `step`, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def places(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / step).cast("int")), lambda b: total(F.slice(a, b * step + 1, F.lit(step))))
        sums = lambda block: F.transform(block, lambda _, i: total(F.slice(block, F.lit(1), i)))
        place = lambda before: F.transform(a, lambda _, i: F.get(before, F.floor(i / step).cast("int")) + total(F.slice(a, F.floor(i / step).cast("int") * step + 1, i % step)))
        return once(blocks, lambda b: once(sums(b), place))

    return once(sizes, places)


def upper_bound(ordered: Column, goes_on: Callable[[Column], Column]) -> Column:
    """How many of the first values of an array hold goes_on, which holds for none after one without it: by halving."""
    bits = F.ceil(F.log2(F.greatest(F.size(ordered), F.lit(1)) + F.lit(1))).cast("int")

    def one(lo: Column, i: Column) -> Column:
        at = lo + F.pow(F.lit(2.0), bits - 1 - i).cast("int")
        return F.when((at <= F.size(ordered)) & goes_on(F.get(ordered, at - 1)), at).otherwise(lo)

    return F.aggregate(F.sequence(F.lit(0), bits - 1), F.lit(0), one)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def released() -> None:
    """Gives free memory back to the system: a Python worker stays beside the next stages' tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` text bytes each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    released()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(text))
    return pc.fill_null(col.cast(pa.large_string()), "")


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, ids, words): the words of text i are words[ids[offsets[i]:offsets[i + 1]]]."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    coded = pc.dictionary_encode(flat)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels no model may see (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def bounded_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled (doc_id, label) rows outside the held-out fifth, in an order by hash."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most)
    )


def one_each(rows: DataFrame) -> DataFrame:
    """The least row of each doc_id, so that repeated ids pass no bound on labelled rows."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")


def spanning(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the connectivity of the bipartite graph `mask`; as many as it has nodes at most."""
    r, c = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not r.size:
        return rows[:0], cols[:0]
    sub, big = mask[np.ix_(r, c)], r.size + c.size
    of_r, of_c = np.arange(c.size, big), np.arange(c.size)
    while True:
        new_r = np.minimum(of_r, np.where(sub, of_c[None, :], big).min(1))
        new_c = np.minimum(of_c, np.where(sub, new_r[:, None], big).min(0))
        if (new_r == of_r).all() and (new_c == of_c).all():
            break
        of_r, of_c = new_r, new_c
    names, own = np.concatenate([cols[c], rows[r]]), np.concatenate([of_c, of_r])
    a, b = names, names[own]
    keep = a != b
    return a[keep], b[keep]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that links reach, from `label` (as this returns it) and further links between places a and b."""
    while (differ := label[a] != label[b]).any():
        x, y = label[a[differ]], label[b[differ]]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, for every node with a link.

    Alternating large-star and small-star steps; each leaves a forest closer to stars,
    in rounds that grow with the logarithm of the nodes. Edges (a, b) are never collected.
    """
    spark = edges.sparkSession
    state = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    def round_of(rows: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark, "edges")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), path

    now, path = round_of(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (size := tuple(state(now))) != before and size[0]:
        before = size
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        old = path
        now, path = round_of(small)
        drop_folder(spark, old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
