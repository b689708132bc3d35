"""File sources and sinks: FASTA, FASTQ, BED tracks, scans; Parquet tables with their parameters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params

BED = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType())])
REPEATS = T.StructType([*BED.fields, T.StructField("score", T.StringType()), T.StructField("strand", T.StringType()), T.StructField("rclass", T.StringType()), T.StructField("family", T.StringType())])


def fasta(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(contig, seq, length) of FASTA records, plain or .gz; the name is the header's first word.

    A record is one row; text before a file's first header is dropped, and so are empty records.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("at"))
    # the one part of a file that keeps its ">" is its first; where none does, the first is no record
    lead = raw.groupBy("file").agg(F.min("at").alias("first"), F.min_by(F.substring("value", 1, 1), "at").alias("mark")).where("mark <> '>'").select("file", F.col("first").alias("at"))
    rows = raw.join(F.broadcast(lead), ["file", "at"], "left_anti")  # one row a file
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\\n') + 1)")).otherwise("")
    rows = rows.where(F.length("value") > 0).select(F.regexp_extract(head, r"^(\S+)", 1).alias("contig"), F.regexp_replace(body, r"\s+", "").alias("seq"))
    return rows.where(F.length("seq") > 0).where(~F.col("contig").isin(*exclude) if exclude else F.lit(True)).withColumn("length", F.length("seq").cast("long"))


def fasta_pieces(spark: SparkSession, path: str, size: int = 1 << 20, overlap: int = 0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(contig, at, seq, length) of FASTA records in pieces: bases at .. at + size of a contig and the next `overlap` ones; length is the contig's.

    Lines are read block by block. What a block's first lines belong to, and where in it
    they stand, comes from the headers and bases of the blocks before it: one row a block.
    No task sees a whole contig. As fasta(): text before a file's first header and empty
    records go. A name that heads several records makes several contigs of that name.
    """
    line = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    line = line.withColumn("head", F.col("value").startswith(">")).withColumn("seq", F.when(F.col("head"), "").otherwise(F.regexp_replace("value", r"\s+", ""))).withColumn("n", F.length("seq"))
    here = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("value", r"^>(\S*)", 1)
    line = line.withColumns({"own": F.last(F.when(F.col("head"), F.struct(name.alias("contig"), F.col("i").alias("record"))), ignorenulls=True).over(here), "upto": F.sum("n").over(here)})
    line = line.withColumn("since", F.last(F.when(F.col("head"), F.col("upto")), ignorenulls=True).over(here))
    # of each block: its last header and the bases after it, or all its bases
    blocks = line.groupBy("file", "block").agg(F.max_by("own", "i").alias("last"), F.max("upto").alias("all"), F.max_by("since", "i").alias("since"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    run = F.sum(F.when(F.col("last").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("come", F.last("last", ignorenulls=True).over(before)).withColumn("run", run).withColumn("tail", F.col("all") - F.coalesce("since", F.lit(0)))
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("open", F.sum("tail").over(within))  # bases of the record that is open at the block's end
    carried = blocks.select("file", "block", F.col("come").alias("come"), F.coalesce(F.lag("open").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("carried"))
    rows = line.join(F.broadcast(carried), ["file", "block"]).where("not head and n > 0")
    of, at = F.coalesce("own", "come"), F.col("upto") - F.col("n") + F.when(F.col("own").isNull(), F.col("carried")).otherwise(-F.col("since"))
    rows = rows.select("file", of.alias("of"), at.alias("at"), "seq", "n").where("of is not null")
    rows = rows.where(~F.col("of.contig").isin(*exclude)) if exclude else rows
    # a line gives its bases to each piece that it meets
    first, last = F.floor((F.col("at") - overlap) / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    parts = rows.select("file", "of", "at", "seq", "n", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))).alias("piece"))
    low, high = F.greatest("at", F.col("piece") * size), F.least(F.col("at") + F.col("n"), (F.col("piece") + 1) * size + overlap)
    parts = parts.select("file", "of", "piece", low.alias("low"), F.expr(f"substring(seq, int(greatest(at, piece * {size}) - at + 1), int(least(at + n, (piece + 1) * {size} + {overlap}) - greatest(at, piece * {size})))").alias("seq"), (F.least(high, (F.col("piece") + 1) * size) - low).alias("own"))
    joined = parts.where(F.length("seq") > 0).groupBy("file", "of", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "seq"))), lambda x: x["seq"]), "").alias("seq"), F.sum(F.greatest("own", F.lit(0))).alias("own"))
    joined = joined.where("own > 0")
    total = joined.groupBy("file", "of").agg(F.sum("own").alias("length"))
    return joined.join(total, ["file", "of"]).select(F.col("of.contig").alias("contig"), (F.col("piece") * size).alias("at"), "seq", "length")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): the lines of text files with their numbers from 0, counted by blocks and not in one task."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("i").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")  # one row a block
    return raw.join(F.broadcast(sizes.withColumn("before", before)), ["file", "block"]).select("file", (F.col("before") + F.col("i") - F.col("first")).alias("n"), "value")


def fastq(spark: SparkSession, path: str, least: int = 0, most: int | None = None) -> DataFrame:
    """(read, seq, qual) of FASTQ records of four lines with `least` bases or more; the first `most` of them in file order."""
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    rows = numbered_lines(spark, path).groupBy("file", F.expr("n div 4").alias("rec")).agg(line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    rows = rows.where(F.col("qual").isNotNull() & (F.length("seq") >= least))
    rows = rows.orderBy("file", "rec").limit(most) if most is not None else rows
    return rows.select(F.regexp_extract("head", r"^@?(\S+)", 1).alias("read"), "seq", "qual")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


POINTER = "current"


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Puts `text` in place of the file at `path` in one step: readers find the old text or the new one."""
    target, fs = _path(spark, path)
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}")[0]
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    qualified = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), qualified, how)


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What `path` points at: its version, the key and the tables of it; None where nothing was published."""
    p, fs = _path(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, writers: dict[str, Callable[[str], None]], key: str = "") -> None:
    """Tables that change together, under one key: readers see all of the old ones or all of the new ones.

    Each writer gets the folder of its table in a new version's folder. The pointer file,
    swapped last, makes the version the current one. A run that stops before leaves the
    old version as it was. The version before the new one stays for those that still read
    it, older and unfinished ones go. One writer at a time.
    """
    before, version = pointer(spark, path), f"v-{uuid.uuid4().hex}"
    for name, write in writers.items():
        write(f"{path}/{version}/{name}")
    _swap(spark, f"{path}/{POINTER}", json.dumps({"version": version, "key": key, "tables": list(writers)}))
    root, fs = _path(spark, path)
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name != POINTER and name not in (version, (before or {}).get("version")):
            fs.delete(entry.getPath(), True)


def publish_tables(path: str, tables: dict[str, DataFrame], key: str = "") -> None:
    """publish() of Parquet tables."""
    spark = next(iter(tables.values())).sparkSession
    publish(spark, path, {name: rows.write.parquet for name, rows in tables.items()}, key)


def folder_of(spark: SparkSession, path: str, table: str) -> str:
    """The folder of a table's current version; FileNotFoundError where there is none."""
    now = pointer(spark, path)
    if now is None or table not in now["tables"]:
        raise FileNotFoundError(f"{path}: {table}")
    return f"{path}/{now['version']}/{table}"


def published(spark: SparkSession, path: str, table: str = "rows") -> DataFrame:
    """The current version of a Parquet table."""
    return spark.read.parquet(folder_of(spark, path, table))


def keyed(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path` if it was published under `key`, else what `build` gives, published there. build is not called on a hit."""
    if (pointer(spark, path) or {}).get("key") != key:
        publish_tables(path, {"rows": build()}, key)
    return published(spark, path)


def cached_contigs(spark: SparkSession, path: str, cache: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """fasta() through a cache that holds for the file's name and size; excluded contigs are cached and not returned."""
    p, fs = _path(spark, path)
    rows = keyed(spark, cache, f"{p.getName()}:{fs.getFileStatus(p).getLen()}", lambda: fasta(spark, path))
    return rows.where(~F.col("contig").isin(*exclude)) if exclude else rows


def cached_scan(spark: SparkSession, cache: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A whole-assembly scan through a cache that holds for a version (of input and parameters)."""
    return keyed(spark, cache, version, build)


def satellites(spark: SparkSession, path: str) -> DataFrame:
    """A satellite track; FileNotFoundError where there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return bed(spark, path)


def bed(spark: SparkSession, path: str, schema: T.StructType = BED, required: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Rows of a tab-separated track; header lines ("track", "#") and rows without the required columns go."""
    rows = spark.read.csv(path, sep="\t", schema=schema)
    return rows.where(~(F.col("chrom").startswith("track") | F.col("chrom").startswith("#"))).dropna(subset=list(required))


def repeats(spark: SparkSession, path: str) -> DataFrame:
    return bed(spark, path, REPEATS, ("chrom", "start", "end", "rclass", "family"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Scans of several samples (Parquet files) with sample, top and j1; one file a sample, its name up to the first dot.

    ValueError if two files name one sample.
    """
    rows = spark.read.parquet(path).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    side = F.when(F.col("_file").contains(".pat"), " pat").when(F.col("_file").contains(".mat"), " mat").otherwise("")
    rows = rows.withColumn("sample", F.concat(F.substring_index("_file", ".", 1), side))
    twice = rows.groupBy("sample").agg(F.count_distinct("_file").alias("files")).where("files > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files of sample {twice[0][0]}")
    return rows.select("*", F.element_at("ehits", 1).alias("top"), F.element_at("ejacc", 1).alias("j1")).drop("_file")


def _key(params: Params) -> str:
    return f"k={params.k} scaled={params.base_scaled} bin_bp={params.bin_bp}"


def write_store(sketch: DataFrame, bins: DataFrame, path: str, params: Params) -> None:
    """A store, sketch and bins in one version: the sketch sorted by hash (so that coarser scales prune row groups), its parameters the key."""
    publish_tables(path, {"sketch": sketch.repartitionByRange("h").sortWithinPartitions("h"), "bins": bins}, _key(params))


def read_store(spark: SparkSession, path: str, params: Params) -> tuple[DataFrame, DataFrame]:
    """(sketch, bins) of a store; ValueError if it was made with other parameters."""
    now = pointer(spark, path) or {"key": "nothing"}
    if now["key"] != _key(params):
        raise ValueError(f"the store has {now['key']}")
    return tuple(spark.read.parquet(f"{path}/{now['version']}/{t}") for t in ("sketch", "bins"))


def write_metrics(metrics: DataFrame, path: str, stage: str) -> None:
    """Metrics (name, value) of one stage; those of other stages stay."""
    publish_tables(f"{path}/{stage}", {"rows": metrics})


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(stage, name, value) of all stages."""
    root, fs = _path(spark, path)
    stages = sorted(e.getPath().getName() for e in fs.listStatus(root) if exists(spark, f"{path}/{e.getPath().getName()}/{POINTER}"))
    return reduce(DataFrame.unionByName, [published(spark, f"{path}/{s}").withColumn("stage", F.lit(s)) for s in stages]).select("stage", "name", "value")


#: The tables of a stage's result and the columns that each has at least, by kind.
RESULTS = {
    "model": {"z": ("row", "z"), "sigma": ("dim", "sigma"), "private": ("row", "private_frac"), "meta": ("k", "scaled", "bin_bp", "n_shared")},
    "embedding": {"bins": ("bin", "x", "y", "cluster", "cluster_prob", "private_frac"), "coordinates": ("bin", "z")},
    "pairs": {"bins": ("contig", "bin", "start", "end"), "pairs": ("contig_a", "bin_a", "contig_b", "bin_b", "inter", "jacc", "maxc", "cani")},
    "annotation": {"rows": ("chrom", "bin", "label", "frac")},
    "periods": {"rows": ("contig", "bin", "period", "strength")},
    "analysis": {"clusters": ("cluster", "n_bins", "dom_class", "dom_class_frac"), "labels": ("bin", "cluster"), "confusion": ("label", "predicted", "n")},
    "acro": {"rows": ("id", "chrom", "promiscuity", "vote"), "summary": ("cls", "n", "promiscuity", "vote_acc")},
    "scan": {"rows": ("contig", "w", "cover", "hits", "sims", "ehits", "ejacc")},
    "bench": {"cells": ("stratum",)},
    "population": {"meter": ("sample", "chrom", "n", "cover"), "commons": ("sample",)},
    "ladder": {"scores": ("k",), "layouts": ("k", "row", "x", "y")},
    "lab": {"settings": ("tag",)},
}


def write_result(tables: dict[str, DataFrame], path: str, kind: str) -> None:
    """A stage's tables as one version of Parquet; ValueError if one of them, or a column of one, is missing."""
    for name, columns in RESULTS[kind].items():
        missing = [name] if name not in tables else [c for c in columns if c not in tables[name].columns]
        if missing:
            raise ValueError(f"{kind} needs {missing}")
    publish_tables(path, tables, kind)


def read_result(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """The tables of a stage's current result; ValueError if it is of another kind."""
    now = pointer(spark, path) or {"key": "nothing", "tables": []}
    if now["key"] != kind:
        raise ValueError(f"{path} holds {now['key']}")
    return {t: spark.read.parquet(f"{path}/{now['version']}/{t}") for t in now["tables"]}


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, published."""
    publish(rows.sparkSession, path, {"json": rows.write.json})


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(folder_of(spark, path, "json"))


def _tsv(rows: DataFrame) -> Callable[[str], None]:
    return lambda folder: rows.write.csv(folder, sep="\t", header=True)


def write_table(rows: DataFrame, path: str) -> None:
    """A flat table as tab-separated text with a header, published."""
    publish(rows.sparkSession, path, {"tsv": _tsv(rows)})


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(folder_of(spark, path, "tsv"), sep="\t", header=True, **options)


def write_triage(rows: DataFrame, path: str) -> None:
    """Triage rows as tab-separated text with a header and as JSON, in one version."""
    publish(rows.sparkSession, path, {"tsv": _tsv(rows), "json": rows.write.json})
