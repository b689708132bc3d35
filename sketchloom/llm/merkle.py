"""Merkle manifest (13): a tree of SHA-256 hashes over the rows of each group, and one over the groups.

Leaves are an RDD sorted by ranges of (group, id). From the number of rows that each
partition holds of its first and last group the driver knows where a partition's leaves
stand in their groups (one entry a partition). So a partition hashes all runs that lie
wholly in it, level by level. The nodes left at its ragged ends, a few a level, are shuffled
by coordinate and hashed upwards. The runs above a partition's ends then come back
to it, and it returns each leaf's proof. The roots of the groups are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, read, written

FANOUT = 8
#: Leaves of a partition, and keys sampled for each bound between partitions.
ROWS, SAMPLED = 1 << 17, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))]))
#: What partitions tell: nodes of runs that are not whole (node), runs they want back (ask), roots of whole trees (top), groups they hold (hold).
TOLD = "kind string, part int, known boolean, grp string, level int, idx bigint, size bigint, h string"


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The hash of a record: of each field `-` if null, else its UTF-8 bytes' number, a colon and the value."""
    coded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.encode(F.concat(*coded), "UTF-8"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""

    def step(h: Column, at: Column) -> Column:
        others = at["others"]
        return F.sha2(F.encode(F.concat(F.array_join(F.slice(others, F.lit(1), at["place"]), ""), h, F.array_join(F.slice(others, at["place"] + 1, F.size(others)), "")), "UTF-8"), 256)

    # a run of one has no others: its node is hashed alone
    return F.aggregate(proof, leaf, step)


def up(size: int) -> int:
    return -(-size // FANOUT)


def grow(own: list[str], at: int, size: int) -> list[tuple[int, int, list[str]]]:
    """(first, size, nodes) of each level: the nodes of a tree over `size` leaves that follow from the leaves own, at place `at`."""
    levels = [(at, size, own)]
    while size > 1 and own:
        end, first, size = at + len(own), up(at), up(size)
        last = size if end == levels[-1][1] else end // FANOUT
        if last <= first:
            break
        own = [hashed(*own[r * FANOUT - at : (r + 1) * FANOUT - at]) for r in range(first, last)]
        at = first
        levels.append((at, size, own))
    return levels


def ragged(levels: list[tuple[int, int, list[str]]]) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    """(level, idx, size, hash) of nodes whose run is not whole here; (level, run) of the runs that proofs of the leaves still need."""
    nodes, runs, below, level, size = [], [], set(), 0, levels[0][1]
    while size > 1:
        wanted = {r // FANOUT for r in below}
        if level < len(levels):
            at, _, own = levels[level]
            first, many = (levels[level + 1][0], len(levels[level + 1][2])) if level + 1 < len(levels) else (at + len(own), 0)
            for i, h in enumerate(own, at):
                if not first * FANOUT <= i < (first + many) * FANOUT:
                    nodes.append((level, i, size, h))
                    wanted.add(i // FANOUT)
        runs += [(level, r) for r in sorted(wanted)]
        below, level, size = wanted, level + 1, up(size)
    return nodes, runs


class Tree:
    """A tree for each group over rows (known, grp, has, id, leaf, tie, claim); known and has tell if grp and id are given.

    tie makes rows with one id and leaf differ, so that ranges can cut between them.
    """

    def __init__(self, rows: DataFrame, per_part: int = ROWS):
        self.spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
        n = rows.count()
        self.parts = parts = max(math.ceil(n / per_part), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n // 1000 + 1))
        sample = rows.select("known", "grp", "has", "id", "leaf", "tie").sample(False, min(1.0, SAMPLED * parts / max(n, 1)), 13).collect() if parts > 1 else []
        keys = sorted(_key(r) for r in sample)
        shared = sc.broadcast([keys[len(keys) * i // parts] for i in range(1, parts)] if keys else [])
        self.part_of = part_of = lambda k: k if isinstance(k, int) else bisect_right(shared.value, k)
        self.ranged = rows.rdd.map(lambda r: (_key(r), r["claim"])).repartitionAndSortWithinPartitions(parts, part_of)
        self.spans = sc.broadcast(self._spans())
        self.told = written(self.spark.createDataFrame(self.ranged.mapPartitionsWithIndex(_teller(self.spans)), TOLD, verifySchema=False), "boundary")
        self.runs = self._finished()
        tops = self.told.where("kind = 'top'").select("known", "grp", F.col("h").alias("subroot"))
        self.tops = tops.union(self.runs.where(F.col("size") <= FANOUT).select("known", "grp", _joined()))

    def _spans(self) -> list[dict]:
        """For each partition, (rows of earlier ones, rows of all) of its first and last group."""

        def ends(at: int, rows: Iterator) -> Iterator:
            found: list = []
            for key, _ in rows:
                if found and found[-1][0] == key[:2]:
                    found[-1][1] += 1
                else:
                    del found[1:]  # the first and the last group are asked for
                    found.append([key[:2], 1])
            yield at, found

        sizes, before = {}, {}
        for at, found in sorted(self.ranged.mapPartitionsWithIndex(ends).collect()):
            for group, many in found:
                before[at, group] = sizes.get(group, 0)
                sizes[group] = sizes.get(group, 0) + many
        out: list[dict] = [{} for _ in range(1 + max((at for at, _ in before), default=0))]
        for (at, group), many in before.items():
            out[at][group] = (many, sizes[group])
        self.height, most = 1, up(max(sizes.values(), default=1))
        while most > 1:
            self.height, most = self.height + 1, up(most)
        return out

    def _finished(self) -> DataFrame:
        """(known, grp, level, run, size, kids): the runs over nodes of several partitions, made from the lowest level up."""
        nodes = self.told.where("kind = 'node'")
        made = self.spark.createDataFrame([], "known boolean, grp string, idx bigint, size bigint, h string")
        levels = []
        for level in range(self.height):
            here = nodes.where(F.col("level") == level).select("known", "grp", "idx", "size", "h").union(made)
            runs = here.groupBy("known", "grp", F.floor(F.col("idx") / FANOUT).alias("run")).agg(F.max("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("kids"))
            levels.append(written(runs.select("known", "grp", F.lit(level).alias("level"), "run", "size", "kids"), f"level{level}"))
            made = levels[-1].where(F.col("size") > FANOUT).select("known", "grp", F.col("run").alias("idx"), F.ceil(F.col("size") / FANOUT).alias("size"), _joined().alias("h"))
        out = levels[0]
        for x in levels[1:]:
            out = out.union(x)
        return out

    def proofs(self, above: DataFrame | None = None) -> RDD:
        """(grp, id, leaf, claim, subroot, root, proof) of each leaf; above: (known, grp, root, proof) of the groups."""
        asked = self.told.where("kind = 'ask'").select("part", "known", "grp", "level", F.col("idx").alias("run"))
        back = asked.join(self.runs, ["known", "grp", "level", "run"]).rdd.map(lambda r: (r["part"], (r["known"], r["grp"], r["level"], r["run"], list(r["kids"]), None)))
        if above is not None:
            held = self.told.where("kind = 'hold'").select("part", "known", "grp")
            back = back.union(held.join(above, ["known", "grp"]).rdd.map(lambda r: (r["part"], (r["known"], r["grp"], -1, 0, r["root"], [(p["place"], list(p["others"])) for p in r["proof"]]))))
        # one partitioning: a partition reads what came back, then its leaves, and no leaf is shuffled again
        return back.partitionBy(self.parts, self.part_of).union(self.ranged).mapPartitionsWithIndex(_prover(self.spans))


def _joined() -> Column:
    return F.sha2(F.encode(F.array_join("kids", ""), "UTF-8"), 256)


def _key(r) -> tuple:  # noqa: ANN001
    return (r["known"], r["grp"], r["has"], r["id"], r["leaf"], r["tie"])


def _portions(at: int, rows: Iterator, spans: list[dict]) -> Iterator[tuple]:
    """(group, rows, levels) of each group of a partition."""
    group, held = None, []

    def portion() -> tuple:
        before, size = (spans[at] if at < len(spans) else {}).get(group, (0, len(held)))
        return group, held, grow([key[4] for key, _ in held], before, size)

    for row in rows:
        if row[0][:2] != group:
            if held:
                yield portion()
            group, held = row[0][:2], []
        held.append(row)
    if held:
        yield portion()


def _teller(spans) -> Callable:  # noqa: ANN001
    def tell(at: int, rows: Iterator) -> Iterator[tuple]:
        for (known, grp), _, levels in _portions(at, rows, spans.value):
            yield "hold", at, known, grp, None, None, None, None
            nodes, runs = ragged(levels)
            for level, i, size, h in nodes:
                yield "node", at, known, grp, level, i, size, h
            for level, run in runs:
                yield "ask", at, known, grp, level, run, None, None
            if levels[-1][1] == 1 and levels[-1][2]:
                yield "top", at, known, grp, None, None, None, levels[-1][2][0]

    return tell


def _prover(spans) -> Callable:  # noqa: ANN001
    def prove(at: int, rows: Iterator) -> Iterator[tuple]:
        back, above = {}, {}

        def leaves() -> Iterator:
            for key, value in rows:
                if not isinstance(key, int):
                    yield key, value
                elif value[2] < 0:
                    above[value[:2]] = value[4:]
                else:
                    back[value[:4]] = value[4]

        for group, held, levels in _portions(at, leaves(), spans.value):
            first, size, _ = levels[0]

            def kids(level: int, run: int, group: tuple = group, levels: list = levels) -> list[str]:
                if level + 1 < len(levels) and 0 <= run - levels[level + 1][0] < len(levels[level + 1][2]):
                    begin = run * FANOUT - levels[level][0]
                    return levels[level][2][begin : begin + FANOUT]
                return back[(*group, level, run)]

            def path(level: int, i: int, size: int, kids: Callable = kids) -> list[tuple[int, list[str]]]:
                out = []
                while size > 1:
                    own = kids(level, i // FANOUT)
                    out.append((i % FANOUT, own[: i % FANOUT] + own[i % FANOUT + 1 :]))
                    level, i, size = level + 1, i // FANOUT, up(size)
                return out

            subroot, run, upper = None, -1, []
            root, rest = above.get(group, (None, []))
            for i, (key, claim) in enumerate(held, first):
                if i // FANOUT != run:  # leaves of a run share what is above it
                    run, upper = i // FANOUT, path(1, i // FANOUT, up(size))
                own = path(0, i, 1 if size == 1 else FANOUT)
                if subroot is None:
                    subroot = key[4]
                    for place, others in own + upper:
                        subroot = hashed(*others[:place], subroot, *others[place:])
                yield key[1] if key[0] else None, key[3] if key[2] else None, key[4], claim, subroot, root or subroot, own + upper + rest

    return prove


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", claim: Column | None = None, per_part: int = ROWS) -> DataFrame:
    """(grp, id, leaf, claim, subroot, root, proof) of each row of docs.

    Leaves ascend by `order` in their group, null first; rows of one id by their leaf, and
    equal rows are leaves each. Every FANOUT consecutive nodes become one (the last run may
    be shorter, even one) until one is left, the subroot. Subroots by group, null first, give
    root likewise. proof: for each level, the place in the run and the run's others. claim: a
    leaf hash of each row, of docs' columns, that folded(claim, proof) can be held against root
    with. Long texts, and columns of any name, count for nothing but the hash; no rows, no result.
    """
    leaf, kind = leaf_of(*[F.col(f) for f in fields]), docs.schema[order].dataType
    none = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    rows = docs.select(F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(order).isNotNull().alias("has"), F.coalesce(F.col(order), none).alias("id"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim"))
    tree = Tree(written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves"), per_part)
    groups = tree.tops.select(F.lit(True).alias("known"), F.lit("").alias("grp"), F.col("known").alias("has"), F.col("grp").alias("id"), F.col("subroot").alias("leaf"), F.col("subroot").alias("claim"), F.lit(0).cast("long").alias("tie"))
    above = Tree(written(groups, "subroots"), per_part).proofs().map(lambda r: (r[1] is not None, r[1] or "", r[5], r[6]))
    schema = lambda *own: T.StructType([*own, T.StructField("root", T.StringType()), T.StructField("proof", PROOF)])
    text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    above = written(docs.sparkSession.createDataFrame(above, schema(T.StructField("known", T.BooleanType()), *text("grp")), verifySchema=False), "groups")
    return docs.sparkSession.createDataFrame(tree.proofs(above), schema(*text("grp"), T.StructField("id", kind), *text("leaf", "claim", "subroot")), verifySchema=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    bent = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.lit(False))
    text = F.when(bent, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    got = manifest(docs, claim=leaf_of(*[text if f == "text" else F.col(f) for f in FIELDS]))
    got = got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.encode(F.array_join(F.flatten(F.col("proof.others")), ""), "UTF-8"), 256).alias("proof_sha256"), folded(F.col("claim"), F.col("proof")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(text if f == "text" else f) for f in FIELDS) + ")"
OP13_SQL = f"""
WITH RECURSIVE records AS (
  SELECT *, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 3 = 0, FALSE) AS bent
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY gid, i) AS rid FROM (
    SELECT *, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY gid) AS size FROM (
      SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS gid, {_LEAF("text")} AS leaf, {_LEAF(f"(CASE WHEN bent THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END)")} AS claim FROM records))
), own AS (
  SELECT gid, 0 AS level, i, size, leaf AS h FROM leaves
  UNION ALL
  SELECT gid, level + 1, i // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM own WHERE size > 1 GROUP BY gid, level, i // 8, size
), above AS (
  SELECT 0 AS gid, 0 AS level, gid - 1 AS i, count(*) OVER () AS size, h FROM own WHERE size = 1
  UNION ALL
  SELECT gid, level + 1, i // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE size > 1 GROUP BY gid, level, i // 8, size
), nodes AS (
  SELECT * FROM own UNION ALL SELECT * FROM above
), beside AS (
  SELECT a.gid, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS low, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS high
  FROM nodes a JOIN nodes b ON a.gid = b.gid AND a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY a.gid, a.level, a.i
), walk AS (
  SELECT rid, gid, 0 AS level, i, size, claim AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT rid, gid, w.level + 1, w.i // 8, (size + 7) // 8, sha256(low || h || high), proof || low || high FROM walk w JOIN beside USING (gid, level, i) WHERE size > 1
), climb AS (
  SELECT rid, 0 AS gid, 0 AS level, gid - 1 AS i, (SELECT count(*) FROM above WHERE level = 0) AS size, h, proof FROM walk WHERE size = 1
  UNION ALL
  SELECT rid, gid, w.level + 1, w.i // 8, (size + 7) // 8, sha256(low || h || high), proof || low || high FROM climb w JOIN beside USING (gid, level, i) WHERE size > 1
)
SELECT doc_id, leaf, o.h AS subroot, a.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = a.h AS verified
FROM leaves l JOIN own o ON o.gid = l.gid AND o.size = 1 JOIN climb c ON c.rid = l.rid AND c.size = 1 JOIN above a ON a.size = 1
"""
