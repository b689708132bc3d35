"""Mixing sources to target weights (6). DataFrame functions only.

The words of a source, its documents one after another, are cut into blocks of a fixed
number of words. The mix has slots of one block each: every output shard draws its slots
among the sources from a multinomial over what the targets still want, so the sources'
totals come out exact, and a source's i-th slot takes the block that a pseudorandom
permutation of the block indices gives i (a new permutation for each pass over the
source). Slots and documents then meet by block index.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, WS_CLASS, read, rowed, unrowed, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 1 << 16
MOST_SHARDS = 4096
ROUNDS = 12
SEED = 6
#: Distinct sources that the driver weighs, at most: their list is the one thing it collects.
MOST_SOURCES = 200_000
#: Rows of one source that one window takes, about, and windows that a source is dealt to at least.
SALT_ROWS, LEAST_SALTS = 50_000, 128


def weighed(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """The target of each source: its weight's share of all sizes, at most `most` times its own.

    What a full source leaves goes to the others by weight, until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_ and left > 0:
        unit = left / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * unit > most * sizes[i]]
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else w[i] * unit
            if full:
                left -= target[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return target


def shards(slots: list[int], seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first, count): multinomial draws of each shard over the slots still wanted."""
    rng, left, total = random.Random(seed), list(slots), sum(slots)
    many = min(MOST_SHARDS, max(1, -(-total // SHARD_SLOTS)))
    out, first = [], [0] * len(slots)
    for shard in range(many):
        room = sum(left) if shard == many - 1 else min(sum(left), -(-total // many))
        drawn = [0] * len(slots)
        while room:  # a draw over a source's rest leaves room: draw that again
            pool, rest, free = [x - d for x, d in zip(left, drawn)], room, sum(x - d for x, d in zip(left, drawn))
            for i, p in enumerate(pool):
                if p <= 0 or rest <= 0:
                    continue
                n = rest if p >= free else rng.binomialvariate(rest, p / free)
                free, rest = free - p, rest - n
                got = min(n, p)
                drawn[i] += got
                room -= got
        for i, n in enumerate(drawn):
            if n:
                out.append((shard, i, first[i], n))
                first[i] += n
                left[i] -= n
    return out


def permuted(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. size - 1 for each key: the swap-or-not shuffle.

    Each round pairs x with k - x (mod size) and swaps the two on a bit of a hash of the
    pair: its own inverse, so a bijection for any size.
    """

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        return F.when(F.xxhash64(F.greatest(x, other), key, r).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(rounds)]), index, one)


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def laid_out(docs: DataFrame) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """(rows, sources): rows (doc_id, source, size, tie, begin), begin being the words before a row in its source."""
    rows = written(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size"), F.count("*")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = sorted(((r[0], int(r[1])) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    salts = max(LEAST_SALTS, -(-max([r[2] for r in totals], default=0) // SALT_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(salts)))
    before = salted.groupBy("source", "salt").agg(F.sum("size").alias("all")).withColumn("before", F.sum("all").over(Window.partitionBy("source").orderBy("salt")) - F.col("all"))
    own = F.sum("size").over(Window.partitionBy("source", "salt").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = salted.withColumn("own", own).alias("a").join(before.alias("b"), F.expr("a.source <=> b.source AND a.salt = b.salt"))
    return out.select("doc_id", "a.source", "size", "tie", (F.col("before") + F.col("own")).alias("begin")), sources


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): every row with its source's figures, and the words that the mix takes.

    rows: doc_id, source, size, tie, begin, number, source_size, target. parts: number
    (of the source), begin (of the row), start and words (a stretch of the row, from 0),
    times (1 to `most`: how often the mix takes it).
    """
    spark = docs.sparkSession
    rows, sources = laid_out(docs)
    target = weighed([n for _, n in sources], weights, most)
    blocks = [-(-n // block) for _, n in sources]
    slots = [min(most * b, round(t / (n / b))) if n else 0 for (_, n), b, t in zip(sources, blocks, target)]
    table = spark.createDataFrame([(i, s, n, t, b) for i, ((s, n), t, b) in enumerate(zip(sources, target, blocks))], "number int, source string, source_size bigint, target double, blocks bigint")
    rows = rows.alias("r").join(F.broadcast(table).alias("t"), F.expr("r.source <=> t.source")).select("doc_id", "r.source", "size", "tie", "begin", "number", "source_size", "target")
    full = rows.where("size > 0")
    spans = full.select("number", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
    spans = spans.select("number", "begin", "block", F.greatest(F.col("block") * block - F.col("begin"), F.lit(0)).alias("start"), (F.least((F.col("block") + 1) * block, F.col("begin") + F.col("size"))).alias("end"))
    spans = spans.select("number", "begin", "block", "start", (F.col("end") - F.col("begin") - F.col("start")).alias("words"))
    drawn = spark.createDataFrame(shards(slots, seed) or [(0, 0, 0, 0)], "shard int, number int, first bigint, count bigint").where("count > 0")
    size_of = table.select("number", "blocks")
    tasks = max(spark.sparkContext.defaultParallelism, min(10_000, sum(slots) // SHARD_SLOTS))  # a fixed number: few small rows make many slots
    chunks = drawn.join(F.broadcast(size_of), "number").select("number", "blocks", "count", "first", F.explode(F.sequence(F.lit(0), F.col("count") - 1, F.lit(SHARD_SLOTS // 8))).alias("at")).repartition(tasks, "number", "first", "at")
    taken_slots = chunks.select("number", "blocks", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("count"), F.col("at") + SHARD_SLOTS // 8) - 1)).alias("slot"))
    # full passes over a source take each block once, whatever their permutation; the slot says which pass
    index = permuted(F.expr("slot % blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "number", F.expr("slot div blocks")))
    times = taken_slots.select("number", index.alias("block")).groupBy("number", "block").agg(F.count("*").alias("times"))
    # by size of what the slots are exploded from, the planner would broadcast them
    return rows, spans.join(times.hint("merge"), ["number", "block"]).select("number", "begin", "start", "words", "times")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    size: words of the text (null or empty: 0). Sources by code point, null last. A
    document's taken words are at most 3 times its size; a row without words takes none.
    Repeated rows lie one after another and are taken each. Reruns agree, and so do runs
    on other partitions. An empty table gives no rows.
    """
    rows, parts = taken(docs, **options)
    sums = parts.groupBy("number", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    joined = rows.where("size > 0").join(sums, ["number", "begin"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return joined.unionByName(rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row's taken words, as often as the mix takes them.

    The columns are those of docs. Copy c of a row (c = 1, 2, 3) holds the words taken c
    times or more, with the white space before each, and keeps the row's other columns;
    n_chars is that of its text. A row of which nothing is taken has no copy.
    """
    rows, parts = taken(docs, **options)
    spans = parts.groupBy("number", "begin").agg(F.sort_array(F.collect_list(F.struct("start", "words", "times"))).alias("_spans"))
    picked = rows.where("size > 0").join(spans, ["number", "begin"]).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source"), "_spans")
    # repeated rows meet each other's spans: number them alike on both sides
    same = Window.partitionBy("_id", "_tie", "_source").orderBy("_spans")
    picked = picked.withColumn("_nth", F.row_number().over(same))
    base = rowed(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"), tie=F.xxhash64("text"))
    base = base.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "tie", "source").orderBy("tie")))
    joined = base.alias("d").join(picked.alias("p"), F.expr("d.doc_id <=> p._id AND d.tie = p._tie AND d.source <=> p._source AND d.nth = p._nth"))
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"([{WS_CLASS}]*{WORD})"), F.lit(1))
    # the words are split below the explode: above it they would be split anew for each span
    joined = joined.select("_row", "_spans", words.alias("_words"))
    joined = joined.select("*", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_spans", lambda x: x["times"])))).alias("_copy"))
    own = F.flatten(F.transform(F.filter("_spans", lambda x: x["times"] >= F.col("_copy")), lambda x: F.slice(F.col("_words"), x["start"].cast("int") + 1, x["words"].cast("int"))))
    made = joined.select("_row", F.ltrim(F.array_join(own, "")).alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.char_length("_new").cast("long")}
    return made.select(*[new.get(c.lower(), old).alias(c) for c, old in zip(docs.columns, unrowed(docs.columns))])


def op6_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
