"""Exact dedup (12): Golomb-coded fingerprint exchange.

Rows are written once as a table bucketed by sender, a sender being a partition of the
input. Each sender sorts the fingerprints of its texts and sends every owner, which holds
a range of fingerprints, its part as a Golomb code of the gaps. The owner answers with a
bitmap of the fingerprints that two senders hold. So a text travels only if its
fingerprint is held twice: such suspects are grouped by SHA-256 and bytes. All joins with
the table are on sender alone, which its buckets serve: its rows are never shuffled.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, new_folder, read, written

#: A fingerprint has so many bits more than the number of rows: one text in 2^SPARE is a suspect by chance.
SPARE = 10
#: Fingerprints that an owner should get.
OWNED = 1 << 22
#: Senders at most (Spark keeps 100,000 buckets); partitions beyond it are merged.
MOST_SENDERS = 50_000


# Golomb codes ----------------------------------------------------------------------------


def _put(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _get(raw: np.ndarray, many: int, width: int) -> np.ndarray:
    out = np.zeros(many, np.uint64)
    for bit in np.unpackbits(raw, count=many * width).reshape(many, width).T if width else ():
        out = out << np.uint64(1) | bit.astype(np.uint64)
    return out


def encode(ordered: np.ndarray) -> bytes:
    """The Golomb code of ascending numbers (uint64): gaps, divided by the parameter that suits their mean.

    Quotients are unary, remainders truncated binary. The bits of all quotients come first,
    then the common bits of all remainders, then the last bits of those that have one more,
    so that numpy reads and writes each kind at once.
    """
    if not len(ordered):
        return b""
    gaps = np.diff(ordered, prepend=np.uint64(0))
    m = max(1, round(math.log(2) * (float(ordered[-1]) / len(ordered))))
    quotient, rest = (gaps // np.uint64(m)).astype(np.int64), gaps % np.uint64(m)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    width = (m - 1).bit_length()
    short = np.uint64((1 << width) - m)  # the remainders below it have a bit less
    longer = rest >= short
    coded = np.where(longer, rest + short, rest)
    head = np.where(longer, coded >> np.uint64(1), coded)
    parts = [np.packbits(unary).tobytes(), _put(head, max(width - 1, 0)), np.packbits((coded[longer] & np.uint64(1)).astype(np.uint8)).tobytes() if width else b""]
    return np.array([len(ordered), m, len(parts[0]), len(parts[1])], np.uint64).tobytes() + b"".join(parts)


def decode(blob: bytes) -> np.ndarray:
    """The numbers that encode() was given."""
    if not blob:
        return np.zeros(0, np.uint64)
    many, m, first, second = (int(x) for x in np.frombuffer(blob, np.uint64, 4))
    raw = np.frombuffer(blob, np.uint8, offset=32)
    ends = np.flatnonzero(np.unpackbits(raw[:first]))[:many]
    quotient = np.diff(ends, prepend=-1) - 1
    width = (m - 1).bit_length()
    rest = np.zeros(many, np.uint64)
    if width:
        short = np.uint64((1 << width) - m)
        rest = _get(raw[first : first + second], many, width - 1)
        longer = rest >= short
        last = np.unpackbits(raw[first + second :], count=int(longer.sum())).astype(np.uint64)
        rest[longer] = (rest[longer] << np.uint64(1) | last) - short
    return np.cumsum(quotient.astype(np.uint64) * np.uint64(m) + rest, dtype=np.uint64)


# the exchange ----------------------------------------------------------------------------


def _labels(spark: SparkSession, many: int) -> DataFrame:
    """(part, sender) for part < many: the sender whose bucket, of `many`, has the number of the part."""
    tries = many * (math.ceil(math.log(many + 1)) + 16)
    bucket = F.pmod(F.hash(F.col("id")), F.lit(many))
    return spark.range(tries).groupBy(bucket.cast("int").alias("part")).agg(F.min("id").alias("sender"))


def _whole() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _table(docs: DataFrame) -> DataFrame:
    """docs as a table bucketed by sender: (id, text, _rest, h, sha, sender, pos, row); _rest: the other columns, if any.

    pos numbers the rows of a sender, row all rows. The files lie in the shared folder and
    go when the driver ends; the table's entry is the session's.
    """
    spark = docs.sparkSession
    many = max(1, min(MOST_SENDERS, docs.rdd.getNumPartitions()))
    rest, _ = beside(docs, "doc_id", "text")
    rows = docs.coalesce(many).select(F.col("doc_id").alias("id"), "text", *rest).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("row", 33).cast("int")).withColumn("pos", F.col("row").bitwiseAND((1 << 33) - 1))
    rows = rows.join(F.broadcast(_labels(spark, many)), "part").drop("part")
    rows = rows.withColumn("h", F.xxhash64(_whole())).withColumn("sha", F.sha2(F.encode(_whole(), "UTF-8"), 256))
    name = f"loom_exact_{uuid.uuid4().hex}"
    rows.write.bucketBy(many, "sender").option("path", new_folder(spark, "senders")).saveAsTable(name)
    return spark.table(name)


def _runs(owner: np.ndarray) -> list[tuple[int, int]]:
    """The bounds of equal neighbours."""
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def suspects(table: DataFrame) -> DataFrame:
    """(sender, bits): which rows of each sender hold a fingerprint that another row holds; bit pos % 64 of bits[pos / 64].

    table: (sender, pos, h), bucketed by sender, h being any 64-bit hash of the text.
    """
    spark = table.sparkSession
    n = max(2, table.count())
    width = min(63, math.ceil(math.log2(n)) + SPARE)
    least = math.ceil(math.log2(spark.sparkContext.defaultParallelism))
    split = min(width, max(least, math.ceil(math.log2(n / OWNED))))
    low = np.uint64(width - split)

    def prints(h: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(h.to_numpy().view(np.uint64) >> np.uint64(64 - width), return_inverse=True, return_counts=True)

    def send(own: pa.Table) -> pa.Table:
        found, _, _ = prints(own.column("h"))
        owner = (found >> low).astype(np.int64)
        cuts = _runs(owner)
        blobs = [encode(found[a:b] - (np.uint64(owner[a]) << low)) for a, b in cuts]
        return pa.table({"sender": pa.array([own.column("sender")[0].as_py()] * len(cuts), pa.int64()), "owner": pa.array([owner[a] for a, _ in cuts], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def reply(got: pa.Table) -> pa.Table:
        each = [decode(x.as_py()) for x in got.column("blob")]
        _, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        twice = np.split(counts[inverse] > 1, np.cumsum([len(x) for x in each])[:-1])
        some = np.array([x.any() for x in twice])
        maps = [np.packbits(x).tobytes() for x, k in zip(twice, some) if k]
        return got.select(["sender", "owner"]).filter(pa.array(some)).append_column("map", pa.array(maps, pa.binary()))

    def mark(own: pa.Table, maps: pa.Table) -> pa.Table:
        none = pa.table({"sender": pa.array([], pa.int64()), "bits": pa.array([], pa.list_(pa.int64()))})
        if not own.num_rows:
            return none
        found, inverse, counts = prints(own.column("h"))
        owner, twice = (found >> low).astype(np.int64), counts > 1
        got = dict(zip(maps.column("owner").to_pylist(), maps.column("map")))
        for a, b in _runs(owner):
            if (raw := got.get(int(owner[a]))) is not None:
                twice[a:b] |= np.unpackbits(np.frombuffer(raw.as_py(), np.uint8), count=b - a).astype(bool)
        pos = own.column("pos").to_numpy()[twice[inverse.ravel()]]
        if not len(pos):
            return none
        bits = np.zeros(int(pos.max()) // 64 + 1, np.uint64)
        np.bitwise_or.at(bits, pos // 64, np.uint64(1) << (pos % 64).astype(np.uint64))
        return pa.table({"sender": pa.array([own.column("sender")[0].as_py()], pa.int64()), "bits": pa.array([bits.view(np.int64)], pa.list_(pa.int64()))})

    own = table.select("sender", "pos", "h")
    messages = own.groupBy("sender").applyInArrow(send, "sender bigint, owner bigint, blob binary")
    replies = messages.groupBy("owner").applyInArrow(reply, "sender bigint, owner bigint, map binary")
    return own.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(mark, "sender bigint, bits array<bigint>")


def _suspect() -> Column:
    return F.coalesce(F.get("bits", F.floor(F.col("pos") / 64).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))) != 0


def grouped(docs: DataFrame) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256, of groups of equal texts.

    Null texts are empty texts. Of each group one row stays, that with the largest doc_id
    (null below all); of several with that doc_id, the one that comes last. keep_id is its
    doc_id. Repeated rows are rows of one group each. Columns of docs with a name of the
    result's are replaced.
    """
    table = _table(docs)
    spark, of_id = docs.sparkSession, docs.schema["doc_id"].dataType
    flags = written(suspects(table), "suspects")
    met = table.join(flags.hint("shuffle_hash"), "sender").where(_suspect())
    # bytes: a row for each text of a task is shuffled; an owner of a SHA-256 must see one text only
    texts = met.groupBy("sha", _whole().alias("text")).agg(F.count("*").alias("n")).groupBy("sha").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    sizes = texts.where("n > 1").select("sha", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts with one SHA-256"))).alias("n"))
    best = met.groupBy("sha").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row")).alias("best"))
    groups = written(sizes.join(best, "sha").select("sha", "n", "best.id", "best.row"), "copies")
    # back to the senders: a row for each text of a sender
    asked = met.select(F.col("sender").alias("to"), F.col("sha").alias("of_sha")).distinct().join(groups.withColumnRenamed("sha", "of_sha"), "of_sha")
    item = T.StructType([T.StructField("id", of_id), T.StructField("row", T.LongType()), T.StructField("n", T.LongType())])
    schema = T.StructType([T.StructField("sender", T.LongType()), T.StructField("of", T.ArrayType(item))])

    def place(own: pa.Table, got: pa.Table) -> pa.Table:
        at = got.select(["id", "row", "n"]).combine_chunks()
        kind = pa.struct([(f.name, f.type) for f in at.schema])
        if not own.num_rows or not got.num_rows:
            return pa.table({"sender": pa.array([], pa.int64()), "of": pa.array([], pa.list_(kind))})
        found = pc.index_in(own.column("sha").combine_chunks(), got.column("of_sha").combine_chunks())
        pos, which = own.column("pos").to_numpy(), np.asarray(pc.fill_null(found, -1))
        order = np.full(int(pos.max()) + 1, -1, np.int64)
        order[pos] = which
        index = pa.array(order, mask=order < 0)
        one = pa.StructArray.from_arrays([at.column(f.name).combine_chunks().take(index) for f in at.schema], fields=list(kind), mask=pa.array(order < 0))
        return pa.table({"sender": pa.array([own.column("sender")[0].as_py()], pa.int64()), "of": pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)})

    placed = written(met.select("sender", "pos", "sha").groupBy("sender").cogroup(asked.groupBy("to")).applyInArrow(place, schema), "answers")
    out = table.join(placed.hint("shuffle_hash"), "sender", "left").withColumn("of", F.get("of", F.col("pos").cast("int")))
    alone = F.col("of").isNull()
    _, back = beside(docs, "doc_id", "text")
    out = out.withColumn("doc_id", F.col("id"))
    return out.select(
        *[back(c) for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")],
        F.when(alone, F.col("id")).otherwise(F.col("of.id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("of.n")).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("of.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs as they are."""
    rest, back = beside(docs, "doc_id", "text")
    return grouped(docs.select("doc_id", "text", *rest)).where("kept").select(*[back(c) for c in docs.columns])


def op12_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
