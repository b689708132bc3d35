"""Line dedup (3): levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches, from the largest doc_id down, so a key's first batch holds the
document that keeps it. A run is a Parquet table sorted by key hash with the documents
that each batch counted for a key and, for keys that were new to the runs before it (an
anti-join), the key's owner. FANOUT runs of a level are merged into one of the next, so a
row is rewritten once a level and each batch meets few runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, drop_folder, new_folder, once, read, rowed, unrowed, upper_bound, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """128 bits of a line's key, or null if the key is under MIN_CHARS code points."""
    key = F.btrim(line, F.lit(WS_CHARS))
    return F.when(F.char_length(key) >= MIN_CHARS, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))


def keys_of(text: Column) -> Column:
    """The key of each line in order, null where a line has none that counts."""
    return F.transform(lines_of(ascii_lower(text)), key_of)


class Runs:
    """The levels of sorted runs: rows (h, g, docs, owner), owner null but in a key's first batch."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _write(self, df: DataFrame, level: int) -> None:
        path = new_folder(self.spark, f"run{level}")
        df.sortWithinPartitions("h", "g").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((path, df.schema))

    def _read(self, run: tuple) -> DataFrame:
        return self.spark.read.schema(run[1]).parquet(run[0])

    def _all(self) -> list[tuple]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def merged(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        return whole.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """batch: (h, g, docs, last), one row a key. Merge-anti-joins the runs and adds its own run."""
        fresh = batch.select("h", "g", "docs", F.col("last").alias("owner"))
        for run in self._all():
            known = self._read(run).where("owner is not null").select("h", "g", F.lit(True).alias("known"))
            fresh = fresh.join(known.hint("merge"), ["h", "g"], "left").select("h", "g", "docs", F.when(F.col("known").isNull(), F.col("owner")).alias("owner"))
        self._write(fresh, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self.merged([self._read(r) for r in old]), level + 1)
            for path, _ in old:
                drop_folder(self.spark, path)
            level += 1

    def total(self) -> DataFrame:
        return self.merged([self._read(r) for r in self._all()])


def drops(docs: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, keys): the keys that a document loses, in order, for those that lose any."""
    spark = docs.sparkSession
    # one row for a key of a document, however often its rows or lines repeat it
    found = docs.select("doc_id", F.explode(F.filter(keys_of(F.col("text")), lambda k: k.isNotNull())).alias("k")).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "k.h", "k.g").distinct()
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    number = F.lit(0)  # of a row's batch: 0 holds the largest ids
    for i, b in reversed(list(enumerate(bounds))):
        number = F.when(F.col("doc_id") <= b, len(bounds) - i).otherwise(number)
    found, path = found.withColumn("batch", number), new_folder(spark, "lines")
    found.write.partitionBy("batch").parquet(path)
    table = spark.read.schema(found.schema).parquet(path)
    runs = Runs(spark)
    for b in range(len(bounds) + 1):
        runs.add(table.where(F.col("batch") == b).groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
    # a table of its own, so that the planner can split a hot key's lines in the join
    hot = written(runs.total().where(F.col("docs") >= min_docs).select("h", "g", "owner"), "hot")
    return table.select("doc_id", "h", "g").join(hot, ["h", "g"]).where("doc_id <> owner").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("h", "g"))).alias("keys"))


def deduplicated(docs: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys
    of 40 code points or more in 5 documents or more lose all their lines but those in
    the largest doc_id. A null or empty text is one empty line, which stays; rows of one
    doc_id are one document for the counts, and each loses the same lines; rows without
    a doc_id count as one document below all others. Columns of docs with a name of the
    result's are replaced.
    """
    lost = drops(docs, batches, min_docs).withColumnRenamed("doc_id", "_of")
    rows = rowed(docs, _id=F.coalesce(F.col("doc_id"), F.lit(-(2**63))), _text=F.coalesce(F.col("text"), F.lit("")))
    out = rows.join(lost, F.col("_id") == F.col("_of"), "left")
    # a line goes if its key is the last of the lost ones that are not above it
    gone = lambda key: once(upper_bound(F.col("keys"), lambda x: x <= key), lambda n: (n > 0) & (F.get("keys", n - 1) == key))
    lines = F.arrays_zip(lines_of(F.col("_text")).alias("line"), keys_of(F.col("_text")).alias("key"))
    kept = F.transform(F.filter(lines, lambda x: x["key"].isNull() | ~gone(x["key"])), lambda x: x["line"])
    out = out.withColumn("_kept", F.when(F.col("keys").isNotNull(), kept)).withColumn("_many", F.size(lines_of(F.col("_text"))))
    none = F.col("keys").isNull()
    return out.select(
        *unrowed([c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]),
        F.col("_many").cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.col("_many") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.when(none, F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("kept_text"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.owner AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
