"""The sketch store: kept k-mer hashes of fixed-width bins, and the algebra on it.

contigs: (contig, seq); a bin is (contig, bin), bin = position div bin_bp. Hashes are
signed longs with the 64 bits; kept ones are not negative for scaled >= 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .products import products

#: Text bytes that one step of text_store() takes; a longer text is a step of its own.
TEXT_BYTES = 4 << 20

def chunked(contigs: DataFrame, k: int, size: int = 1 << 22) -> DataFrame:
    """contigs as rows (contig, at, seq) of about `size` bases that overlap by k - 1: long contigs spread over tasks."""
    cut = contigs.select("contig", F.posexplode(S.pieces(F.col("seq"), size, k - 1)).alias("i", "part"))
    return cut.select("contig", (F.col("i").cast("long") * size).alias("at"), F.col("part").alias("seq"))


def hits(contigs: DataFrame, k: int = 21, scaled: int = 20, seed: int = 42) -> DataFrame:
    """(contig, pos, h) of the kept canonical k-mers under MurmurHash3, by the vectorised kernel."""
    return _hits(chunked(contigs, k), k, S.max_hash(scaled), lambda c, k: S.hash_codes(c, k, seed))


def piece_hits(pieces: DataFrame, k: int = 21, scaled: int = 20, seed: int = 42) -> DataFrame:
    """hits() of contigs in pieces (contig, at, seq) that overlap by k - 1 bases."""
    return _hits(pieces.select("contig", "at", "seq"), k, S.max_hash(scaled), lambda c, k: S.hash_codes(c, k, seed))


def portable_hits(contigs: DataFrame, k: int = 21, scaled: int = 20) -> DataFrame:
    """As hits(), with the portable hash."""
    return _hits(chunked(contigs, k), k, (1 << S.PORTABLE_BITS) // scaled, S.portable_hashes)


def ladder_hits(contigs: DataFrame, ks: tuple[int, ...], scaled: int = 20, size: int = 1 << 22) -> DataFrame:
    """(k, contig, pos, h) of the portable hits of several word lengths, from one pass over the bases."""
    key, keep = contigs.schema["contig"].dataType.simpleString(), (1 << S.PORTABLE_BITS) // scaled

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, codes = _codes(batch.column(2))
            for k in ks:
                own, at, h = _kept(begin, codes, k, keep, S.portable_hashes)
                inside = at < size  # the rest of the overlap belongs to the next piece
                own, at, h = own[inside], at[inside], h[inside]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), batch.column(0).take(pa.array(own)), pa.array(batch.column(1).take(pa.array(own)).to_numpy() + at), pa.array(h.view(np.int64))], names=["k", "contig", "pos", "h"])

    return chunked(contigs, max(ks), size).mapInArrow(op, f"k int, contig {key}, pos bigint, h bigint")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(begin, codes) of a batch's sequences: their bases as codes, one after another."""
    seqs = column.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    return offsets - offsets[0], S.encode(np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])


def _kept(begin: np.ndarray, codes: np.ndarray, k: int, keep: int, hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place in it, hash) of the kept k-mers that do not run over the end of a sequence."""
    pos, h = S.sketch_codes(codes, k, keep, hashed)
    own = np.searchsorted(begin, pos, side="right") - 1
    inside = pos + k <= begin[own + 1]
    return own[inside], (pos - begin[own])[inside], h[inside]


def _hits(pieces: DataFrame, k: int, keep: int, hashed) -> DataFrame:
    if not 4 <= k <= 31:
        raise ValueError("k must lie in 4 .. 31")
    key = pieces.schema["contig"].dataType.simpleString()

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, h = _kept(*_codes(batch.column(2)), k, keep, hashed)
            row = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(batch.column(1).take(row).to_numpy() + at), pa.array(h.view(np.int64))], names=["contig", "pos", "h"])

    return pieces.mapInArrow(op, f"contig {key}, pos bigint, h bigint")


def _squeezed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, ends, codes) of steps of a batch's texts: the place of the step's first text, where each text's bases begin, and the bases' codes."""
    raw = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff((offsets - offsets[0]) // TEXT_BYTES)) + 1).tolist(), len(raw)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            letters = S.squeezed_codes(data[offsets[a] : offsets[b]])
            on = letters < 4
            yield a, np.concatenate([[0], np.cumsum(on)])[offsets[a : b + 1] - offsets[a]], letters[on]


def text_bins(texts: DataFrame, bin_bp: int) -> DataFrame:
    """bins() of texts (contig, text) whose letters stand for bases (squeezed()), from their bytes in one kernel."""
    key = texts.schema["contig"].dataType.simpleString()

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ends, codes in _squeezed(batch.column(1)):
                size = np.diff(ends)
                many = -(-size // bin_bp)
                own = np.repeat(np.arange(len(size)), many)
                start = (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)) * bin_bp
                end, gcs = np.minimum(start + bin_bp, size[own]), np.concatenate([[0], np.cumsum((codes == 1) | (codes == 2))])
                gc = (gcs[ends[own] + end] - gcs[ends[own] + start]) / (end - start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + own)), *[pa.array(x) for x in (start // bin_bp, start, end, end - start, gc)]], names=["contig", "bin", "start", "end", "acgt", "gc"])

    return texts.select("contig", "text").mapInArrow(op, f"contig {key}, bin bigint, start bigint, end bigint, acgt bigint, gc double")


def text_store(texts: DataFrame, k: int, scaled: int, bin_bp: int, portable: bool = False, seed: int = 42) -> DataFrame:
    """store() of texts (contig, text) whose letters stand for bases (squeezed()), from their bytes in one kernel.

    Texts are squeezed, encoded, hashed and counted by bin in one Arrow step; what one step
    counts is added up by the shuffle. A text is one row, so none may pass a task's memory.
    """
    key = texts.schema["contig"].dataType.simpleString()
    keep, hashed = ((1 << S.PORTABLE_BITS) // scaled, S.portable_hashes) if portable else (S.max_hash(scaled), lambda c, k: S.hash_codes(c, k, seed))
    if not 4 <= k <= 31:
        raise ValueError("k must lie in 4 .. 31")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ends, codes in _squeezed(batch.column(1)):
                own, at, h = _kept(ends, codes, k, keep, hashed)
                place, h = np.stack([own, at // bin_bp]), h.view(np.int64)
                order = np.lexsort((h, place[1], place[0]))
                place, h = place[:, order], h[order]
                new = np.flatnonzero(np.append(True, (np.diff(place, axis=1) != 0).any(0) | (np.diff(h) != 0))[: len(h)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + place[0][new])), pa.array(place[1][new]), pa.array(h[new]), pa.array(np.diff(np.append(new, len(h))))], names=["contig", "bin", "h", "n"])

    return texts.select("contig", "text").mapInArrow(op, f"contig {key}, bin bigint, h bigint, n bigint").groupBy("contig", "bin", "h").agg(F.sum("n").alias("n"))


def kmers(contigs: DataFrame, k: int, piece: int = 256) -> DataFrame:
    """(contig, pos, kmer) of all canonical k-mers of A, C, G and T, by DataFrame functions.

    Positions are taken within short pieces, since a substring is found from its string's start.
    """
    if piece < k:
        raise ValueError("pieces must hold a k-mer")
    cut = contigs.select("contig", F.posexplode(S.pieces(F.upper("seq"), piece, k - 1)).alias("i", "part"))
    n = F.least(F.lit(piece), F.length("part") - k + 1)
    at = cut.where(F.length("part") >= k).select("contig", "i", "part", F.explode(F.sequence(F.lit(0), n - 1)).alias("p"))
    each = at.select("contig", (F.col("i").cast("long") * piece + F.col("p")).alias("pos"), F.substring("part", F.col("p") + 1, F.lit(k)).alias("kmer"))
    return each.where(F.translate("kmer", "ACGT", "") == "").select("contig", "pos", S.canonical(F.col("kmer")).alias("kmer"))


def store(found: DataFrame, bin_bp: int) -> DataFrame:
    """(contig, bin, h, n): kept hashes of each bin with their counts; a k-mer belongs to the bin of its start."""
    return found.groupBy("contig", F.expr(f"pos div {bin_bp}").alias("bin"), "h").agg(F.count("*").alias("n"))


def bins(contigs: DataFrame, bin_bp: int) -> DataFrame:
    """(contig, bin, start, end, acgt, gc) of every bin; gc is a share of the valid bases."""
    return piece_bins(contigs.select("contig", F.lit(0).cast("long").alias("at"), "seq", F.length("seq").cast("long").alias("length")), bin_bp)


def piece_bins(pieces: DataFrame, bin_bp: int, size: int | None = None) -> DataFrame:
    """bins() of contigs in pieces (contig, at, seq, length) of `size` own bases, a multiple of bin_bp."""
    if size is not None and size % bin_bp:
        raise ValueError("a bin must lie in one piece")
    own = F.col("seq") if size is None else F.substring("seq", 1, size)
    each = pieces.select("contig", F.col("length").alias("len"), "at", F.posexplode(S.pieces(own, bin_bp, 0)).alias("bin", "part")).withColumn("bin", F.expr(f"at div {bin_bp}") + F.col("bin")).drop("at")
    part = F.upper("part")
    count = lambda letters: F.length(F.regexp_replace(part, f"[^{letters}]", "")).cast("long")
    out = each.select("contig", "bin", (F.col("bin") * bin_bp).alias("start"), F.least((F.col("bin") + 1) * bin_bp, F.col("len")).alias("end"), count("ACGT").alias("acgt"), count("GC").alias("gcs"))
    return out.select("contig", "bin", "start", "end", "acgt", (F.col("gcs") / F.greatest("acgt", F.lit(1))).alias("gc"))


def with_sizes(dim: DataFrame, sketch: DataFrame, scaled: int) -> DataFrame:
    """dim with sketch_size and distinct_est; bins without a kept hash have 0."""
    sizes = sketch.groupBy("contig", "bin").agg(F.count("*").alias("sketch_size"))
    out = dim.join(sizes, ["contig", "bin"], "left").withColumn("sketch_size", F.coalesce("sketch_size", F.lit(0)))
    return out.withColumn("distinct_est", F.col("sketch_size") * scaled)


def downsampled(sketch: DataFrame, most: int) -> DataFrame:
    """The store at a coarser scale: hashes up to `most`, inclusive. The predicate reaches the scan."""
    return sketch.where(F.col("h") <= most)


def document_frequency(sketch: DataFrame) -> DataFrame:
    return sketch.groupBy("h").agg(F.count("*").alias("df"))


def private_fraction(dim: DataFrame, sketch: DataFrame, min_df: int = 2) -> DataFrame:
    """(contig, bin, sketch_size, private_frac): the share of a bin's hashes in under min_df bins; 0 for empty bins."""
    own = sketch.join(document_frequency(sketch), "h").groupBy("contig", "bin").agg(F.count("*").alias("sketch_size"), F.count_if(F.col("df") < min_df).alias("private"))
    out = dim.select("contig", "bin").join(own, ["contig", "bin"], "left")
    return out.select("contig", "bin", F.coalesce("sketch_size", F.lit(0)).alias("sketch_size"), F.coalesce(F.col("private") / F.greatest("sketch_size", F.lit(1)), F.lit(0.0)).alias("private_frac"))


def parents(sketch: DataFrame, factor: int) -> DataFrame:
    """The store of bins `factor` times as wide: a union of hashes, counts added."""
    return sketch.groupBy("contig", F.expr(f"bin div {factor}").alias("bin"), "h").agg(F.sum("n").alias("n"))


def parent_bins(dim: DataFrame, factor: int) -> DataFrame:
    gcs = F.sum(F.col("gc") * F.col("acgt")) / F.greatest(F.sum("acgt"), F.lit(1))
    return dim.groupBy("contig", F.expr(f"bin div {factor}").alias("bin")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("acgt").alias("acgt"), gcs.alias("gc"))


def tfidf(sketch: DataFrame, n_bins: int | Column, min_df: int = 2) -> DataFrame:
    """(contig, bin, h, w): log1p(count) * log1p(bins / df) of shared hashes, unit rows."""
    shared = document_frequency(sketch).where(F.col("df") >= min_df)
    w = F.log1p("n") * F.log1p(n_bins / F.col("df"))
    raw = sketch.join(shared, "h").select("contig", "bin", "h", w.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("contig", "bin")))
    return raw.withColumn("norm", norm).select("contig", "bin", "h", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("w"))


def pairs(sketch: DataFrame, k: int) -> DataFrame:
    """(contig_a, bin_a, contig_b, bin_b, inter, jacc, maxc, cani) of all pairs of bins that share a hash, a before b.

    Exact. Hashes of one bin only cannot contribute and leave; equal bins keep their own
    rows, since the result is one row a pair.
    """
    one = sketch.select("contig", "bin", "h")
    sizes = one.groupBy("contig", "bin").agg(F.count("*").alias("size"))
    inter = products(one.select(F.struct("contig", "bin").alias("row"), "h")).select("a", "b", F.col("n").alias("inter"))
    of = lambda x: sizes.select(F.struct("contig", "bin").alias(x), F.col("size").alias(f"size_{x}"))
    both = inter.join(of("a"), "a").join(of("b"), "b")
    maxc = F.col("inter") / F.least("size_a", "size_b")
    return both.select(F.col("a.contig").alias("contig_a"), F.col("a.bin").alias("bin_a"), F.col("b.contig").alias("contig_b"), F.col("b.bin").alias("bin_b"), "inter", (F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter"))).alias("jacc"), maxc.alias("maxc"), F.pow(F.least(F.lit(1.0), maxc), F.lit(1.0 / k)).alias("cani"))


def distances(found: DataFrame, sketch: DataFrame) -> DataFrame:
    """(a, b, d_jacc, d_ani) of all ordered pairs of bins of one sketch, zero pairs and the diagonal (0) included.

    found: pairs() of the sketch. For bins of a bounded number only: the result is their square.
    """
    names = sketch.select(F.struct("contig", "bin").alias("a")).distinct()
    every = names.agg(F.sort_array(F.collect_list("a")).alias("all"))
    grid = names.join(F.broadcast(every), how="cross").select("a", F.explode("all").alias("b"))  # one row of names
    one = found.select(F.struct(F.col("contig_a").alias("contig"), F.col("bin_a").alias("bin")).alias("a"), F.struct(F.col("contig_b").alias("contig"), F.col("bin_b").alias("bin")).alias("b"), "jacc", "cani")
    both = one.union(one.select(F.col("b"), F.col("a"), "jacc", "cani"))
    same = F.col("a") == F.col("b")
    near = lambda c: F.when(same, 0.0).otherwise(1 - F.coalesce(c, F.lit(0.0)))
    return grid.join(both, ["a", "b"], "left").select("a", "b", near("jacc").alias("d_jacc"), near("cani").alias("d_ani"))


def top_hits(query: DataFrame, sketch: DataFrame, k: int = 8) -> DataFrame:
    """(query, rank, contig, bin, jacc): the k bins nearest to each query's hashes, ties by (contig, bin).

    query: (query, h). Bins that share no hash are left out (their Jaccard is 0).
    """
    q = query.select("query", "h").distinct()
    size_q, size_b = q.groupBy("query").agg(F.count("*").alias("size_q")), sketch.groupBy("contig", "bin").agg(F.count("*").alias("size_b"))
    inter = products(q.withColumnRenamed("query", "row"), sketch.select(F.struct("contig", "bin").alias("row"), "h")).select(F.col("a").alias("query"), "b.contig", "b.bin", F.col("n").alias("inter"))
    scored = inter.join(size_q, "query").join(size_b, ["contig", "bin"]).withColumn("jacc", F.col("inter") / (F.col("size_q") + F.col("size_b") - F.col("inter")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("jacc"), "contig", "bin"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query", "rank", "contig", "bin", "jacc")


def cover(query: DataFrame, sketch: DataFrame, k: int) -> DataFrame:
    """(query, n_hashes, n_distinct, cover, err): the share of a query's distinct hashes that the store knows, and the error meter 1 - cover^(1/k)."""
    known = sketch.select("h").distinct().withColumn("known", F.lit(1))
    each = query.groupBy("query", "h").agg(F.count("*").alias("n")).join(known, "h", "left")
    out = each.groupBy("query").agg(F.sum("n").alias("n_hashes"), F.count("*").alias("n_distinct"), F.avg(F.coalesce("known", F.lit(0))).alias("cover"))
    return out.withColumn("err", 1 - F.pow("cover", F.lit(1.0 / k)))
