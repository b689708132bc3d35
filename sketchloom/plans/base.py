"""Registration of queries, and the SQL fragments that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import sketch as K
from ..session import read, spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: k-mer length, scale and bin width of the queries over documents.
KMER, SCALED, BIN = 21, 20, 200
#: Bits of the portable hash, and its largest kept value.
KEEP = (1 << 60) // SCALED


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that states it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def contigs(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """Texts as contigs: (contig, seq)."""
    rows = spread(read(spark, sf_dir, table).where("text is not null").select(key, "text"), key)
    return rows.select(F.col(key).alias("contig"), S.squeezed(F.col("text")).alias("seq"))


def texts(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """(contig, text) of a table."""
    rows = spread(read(spark, sf_dir, table).where("text is not null").select(key, "text"), key)
    return rows.withColumnRenamed(key, "contig")


def doc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of the documents, sketched once and written: a plan that reads it several times scans no text again."""
    return written(K.text_store(texts(spark, sf_dir), KMER, SCALED, BIN, portable=True), "store")


def wide_store(spark: SparkSession, sf_dir: str, factor: int = 50) -> DataFrame:
    """The store of bins `factor` times as wide, written in place of the narrow one."""
    return written(K.parents(K.text_store(texts(spark, sf_dir), KMER, SCALED, BIN, portable=True), factor), "wide-store")


def doc_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bins() of the documents."""
    return K.text_bins(texts(spark, sf_dir), BIN)


def sql_seqs(table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key} AS contig, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {table} WHERE text IS NOT NULL"


def sql_kmers(k: int, table: str = "documents", key: str = "doc_id", seqs: str | None = None) -> str:
    """(contig, pos, kmer) of all canonical k-mers of a table's texts, or of sequences (contig, seq)."""
    return f"""SELECT contig, pos, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM (
      SELECT contig, pos, substr(seq, pos + 1, {k}) AS f FROM (
        SELECT contig, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM ({seqs or sql_seqs(table, key)}) WHERE length(seq) >= {k}))"""


def sql_hits(k: int = KMER, table: str = "documents", key: str = "doc_id", keep: int = KEEP, seqs: str | None = None) -> str:
    """(contig, pos, h) of the kept k-mers under the portable hash."""
    return f"SELECT * FROM (SELECT contig, pos, {S.portable_sql('kmer', k)} AS h FROM ({sql_kmers(k, table, key, seqs)})) WHERE h <= {keep}"


def sql_murmur(kmer: str, k: int, rows: str, seed: int = 42) -> str:
    """rows with h, the low 64 bits of MurmurHash3 x64-128 of a k-mer of 17 to 24 bases: one block and a short tail.

    Products are taken in 128 bits and cut to 64; each layer adds the columns that the next one needs.
    """
    c1, c2, top = 0x87C37B91114253D5, 0x4CF5AD432745937F, 1 << 64
    cut = lambda x: f"CAST(({x}) % {top}::UHUGEINT AS UBIGINT)"
    times = lambda a, b: cut(f"{a}::UHUGEINT * {b}::UHUGEINT")
    plus = lambda a, b: cut(f"{a}::UHUGEINT + {b}::UHUGEINT")
    turned = lambda x, r: cut(f"({x})::UHUGEINT * {1 << r}::UHUGEINT + ({x})::UHUGEINT // {1 << (64 - r)}::UHUGEINT")
    word = lambda at, n: "CAST(" + " + ".join(f"ascii(substr({kmer}, {at + j + 1}, 1))::UHUGEINT * {1 << (8 * j)}::UHUGEINT" for j in range(n)) + " AS UBIGINT)"
    layers = [
        {"a": word(0, 8), "b": word(8, 8), "t": word(16, k - 16)},
        {"a": times("a", c1), "b": times("b", c2), "t": times("t", c1)},
        {"a": turned("a", 31), "b": turned("b", 33), "t": turned("t", 31)},
        {"a": times("a", c2), "b": times("b", c1), "t": times("t", c2)},
        {"a": turned(f"xor({seed}::UBIGINT, a)", 27)},
        {"a": cut(f"(a::UHUGEINT + {seed}) * 5::UHUGEINT + {0x52DCE729}::UHUGEINT")},
        {"b": turned(f"xor({seed}::UBIGINT, b)", 31)},
        {"b": cut(f"(b::UHUGEINT + a::UHUGEINT) * 5::UHUGEINT + {0x38495AB5}::UHUGEINT")},
        {"a": f"xor(xor(a, t), {k}::UBIGINT)", "b": f"xor(b, {k}::UBIGINT)"},
        {"a": plus("a", "b")},
        {"b": plus("b", "a")},
        *[step for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53) for step in ({c: f"xor({c}, {c} >> 33)" for c in "ab"}, {c: times(c, m) for c in "ab"})],
        {c: f"xor({c}, {c} >> 33)" for c in "ab"},
        {"a": plus("a", "b")},
    ]
    out = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in layers[0].items())} FROM ({rows})"
    for layer in layers[1:]:
        out = f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in layer.items())}) FROM ({out})"
    return f"SELECT * EXCLUDE (a, b, t), a AS h FROM ({out})"


def sql_murmur_store(k: int, scaled: int, bin_bp: int, table: str, key: str) -> str:
    """(contig, bin, h, n) of a table's texts under MurmurHash3."""
    hits = sql_murmur("kmer", k, sql_kmers(k, table, key))
    return f"SELECT contig, pos // {bin_bp} AS bin, CAST(h AS BIGINT) AS h, count(*) AS n FROM ({hits}) WHERE h <= {S.max_hash(scaled)} GROUP BY ALL"


SQL_STORE = f"SELECT contig, pos // {BIN} AS bin, h, count(*) AS n FROM ({sql_hits()}) GROUP BY ALL"
SQL_BINS = f"""SELECT contig, b AS bin, b * {BIN} AS start, least((b + 1) * {BIN}, length(seq)) AS "end",
    length(regexp_replace(substr(seq, b * {BIN} + 1, {BIN}), '[^ACGT]', '', 'g')) AS acgt, length(regexp_replace(substr(seq, b * {BIN} + 1, {BIN}), '[^GC]', '', 'g')) AS gcs
  FROM (SELECT contig, seq, unnest(range(0, (length(seq) - 1) // {BIN} + 1)) AS b FROM ({sql_seqs()}) WHERE length(seq) > 0)"""
SQL_DF = "SELECT h, count(*) AS df FROM store GROUP BY h"
