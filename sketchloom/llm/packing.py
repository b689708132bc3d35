"""Best-fit packing (8): documents into fixed-length sequences by vector best-fit.

Only the lengths of documents matter to a packing, so it is found on their histogram (one
count for each length up to the capacity) and every bin class stands for many bins alike.
The documents then take their places by rank within their length, computed by salted
windows: no list of documents or bins is ever gathered.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import read, steps, texts_of, written

CAPACITY = 1024
END = 2
#: Encoded chunks that a Python worker remembers, at most.
REMEMBER = 400_000
#: Rows of one length that one window takes, about.
SALT_ROWS = 50_000
#: Texts where cutting at single blanks and newlines might not be what the vocabulary's own
#: splitter does: other white space, control characters, three blanks in a row, blanks at the end.
_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n]{3}|[ \n]{2}\z"
#: Fixed values of byte-level vocabularies: the split pattern, and the bytes that stand for themselves.
_PATTERN = public_tokenizers.PATTERN
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Token ids of whole texts for a byte-level vocabulary file.

    Usual texts are cut where the vocabulary always cuts (before a single blank and
    around a newline); each different chunk is encoded once and remembered. Other texts
    go to the tokenizer whole.
    """

    def __init__(self, source: str):
        self.whole = Tokenizer.from_str(source)
        self.whole.encode_special_tokens = True
        own = json.loads(source)
        char = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
        ranks = {bytes(char[c] for c in t): i for t, i in own["model"]["vocab"].items() if all(c in char for c in t)}
        self.part = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t != b"<|endoftext|>"}, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self, chunks: list[str]) -> None:
        encode = self.part._core_bpe.encode_ordinary
        ids = [encode(c) for c in chunks]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.known), int(size.sum())
        while first + len(ids) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.begin[first : first + len(ids)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(ids)] = size
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.used += total
        self.known.update(zip(chunks, range(first, first + len(ids))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
        usual = np.flatnonzero(~odd)
        if len(usual):
            marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(usual)), " ", "\0 "), "\n", "\0\n\0")
            lists = pc.split_pattern(marked, "\0")
            coded = pc.dictionary_encode(lists.flatten())
            chunks = coded.dictionary.to_pylist()
            if len(self.known) + len(chunks) > REMEMBER:
                self.forget()
            number = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
            new = np.flatnonzero(number < 0)
            number[new] = len(self.known) + np.arange(len(new))
            self._learn([chunks[k] for k in new])
            place = number[np.asarray(coded.indices)]
            size = self.size[place]
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(self.begin[place] - (ends - size), size) + np.arange(size.sum())]
            bounds = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            cut = np.concatenate([[0], ends])[bounds]
            for k, i in enumerate(usual):
                out[i] = ids[cut[k] : cut[k + 1]]
        return out


def tokenized(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n, crcs, ids): tokens with the end mark, and the CRC32 of each piece.

    ids is null unless asked for. The vocabulary file is read by the driver and broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in steps(batch, most=4 << 20):
                n, crcs, kept = [], [], []
                for ids in encoder.encode(texts_of(part)):
                    ids = np.append(ids, end).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    raw, cuts = ids.tobytes(), [0, *range(4 * first, 4 * len(ids) + 1, 4 * capacity)]
                    n.append(len(ids))
                    crcs.append([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])])
                    kept.append(ids.astype(np.int32) if keep_ids else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "n", "crcs", "ids"])

    return docs.select("doc_id", "text").mapInArrow(op, "doc_id bigint, n bigint, crcs array<bigint>, ids array<int>")


@dataclass
class Plan:
    """Places of the items: those of a length with ranks from `rank` on go to sequences from `sequence` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of items."""
        bits = 44
        at = np.searchsorted((self.length << bits) | self.rank, (length << bits) | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def vector_best_fit(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> Plan:
    """Places for counts[length] items of each length, longest first.

    A bin has three capacities: tokens, documents and attention cost (the sum of squared
    lengths; unset: what its tokens allow at most). An item goes to the bin that holds it
    under every one of them and whose weighted residual has the least norm after it
    (score "norm"), or the largest dot product with the item ("dot"); without such a bin
    a new one opens. Bins of one content are one class with a count, so the work depends
    on the lengths and classes, not on the items.
    """
    cap = np.array([capacity, max_docs or capacity, max_cost or capacity**2], float)
    w = np.array(weights) / cap
    size = 1 << 12
    left, many = np.zeros((size, 3)), np.zeros(size, np.int64)
    content: list[tuple] = [()] * size
    top = 0

    def add(residual: np.ndarray, count: int, items: tuple) -> None:
        nonlocal left, many, top
        if top == len(many):
            left, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
            content.extend([()] * top)
        left[top], many[top], content[top] = residual, count, items
        top += 1

    done: list[tuple[int, tuple]] = []
    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        item, todo = np.array([length, 1, length**2], float), int(counts[length])
        if (item > cap).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacities")
        while todo:
            able = np.flatnonzero((left[:top] >= item).all(1) & (many[:top] > 0))
            if len(able):
                after = (left[able] - item) * w
                k = able[(after**2).sum(1).argmin() if score == "norm" else (after * (item * w)).sum(1).argmax()]
                n = min(todo, int(many[k]))
                many[k] -= n
                add(left[k] - item, n, (content[k], length))
                todo -= n
            else:
                fit = int(min(cap // item))
                for per, bins in ((fit, todo // fit), (todo % fit, 1)):
                    if per and bins:
                        items: tuple = ()
                        for _ in range(per):
                            items = (items, length)
                        add(cap - per * item, bins, items)
                        todo -= per * bins
        # classes that are empty or full for good leave the search
        open_ = np.flatnonzero(many[:top] > 0)
        shut = open_[(left[open_] < np.array([1, 1, 1])).any(1)]
        done += [(int(many[k]), content[k]) for k in shut]
        stay = np.setdiff1d(open_, shut)
        left[: len(stay)], many[: len(stay)] = left[stay], many[stay]
        content[: len(stay)] = [content[k] for k in stay]
        top = len(stay)
    done += [(int(many[k]), content[k]) for k in range(top) if many[k]]
    rows, sequence, rank = [], 0, dict.fromkeys(counts, 0)
    for count, items in done:
        offset, held = 0, []
        while items:
            items, length = items
            held.append(length)
        for length in reversed(held):
            rows.append((length, rank[length], sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*table.T.copy(), sequence)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    A row longer than the capacity is cut into full pieces, the first one shorter. A null
    or empty text is its end mark alone. Repeated rows are packed each. Full pieces have
    sequences of their own, with negative numbers; an empty table gives no rows.
    """
    table = written(tokenized(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), capacity, end, keep_ids), "tokens")
    table = table.withColumn("first", (F.col("n") - 1) % capacity + 1)
    counts = {int(r[0]): int(r[1]) for r in table.groupBy("first").count().collect()}  # a row for each length: capacity rows at most
    plan = vector_best_fit({k: c for k, c in counts.items()}, capacity, **limits)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    salts = max(16, -(-sum(counts.values()) // SALT_ROWS))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n", "crcs"), F.lit(salts)).cast("int"))
    before = salted.groupBy("first", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("first").orderBy("salt")) - F.col("count")).select("first", "salt", "before")
    own = F.row_number().over(Window.partitionBy("first", "salt").orderBy("doc_id", "n", "crcs")) - 1
    ranked = salted.withColumn("own", own).join(before, ["first", "salt"]).select("doc_id", "n", "crcs", "ids", "first", (F.col("before") + F.col("own")).alias("rank"))
    begin, total = {}, 0
    for k in sorted(counts):
        begin[k], total = total, total + counts[k]
    starts = np.zeros(capacity + 1, np.int64)
    starts[list(begin)] = list(begin.values())

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, first, rank = (batch.column(i).to_numpy() for i in (1, 4, 5))
            sequence, offset = shared.value.place(first, rank)
            pieces = (n - first) // capacity + 1
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lead = piece == 0
            start = np.where(lead, 0, first[row] + (piece - 1) * capacity)
            length = np.where(lead, first[row], capacity)
            # full pieces after the first: a number of the row's own place among all rows, and the piece
            alone = -(((starts[first] + rank)[row] << 20) + piece)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), batch.column(2).flatten(), pa.array(np.where(lead, sequence[row], alone)), pa.array(np.where(lead, offset[row], 0))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if keep_ids:
                ids = [batch.column(3)[int(r)].values.slice(int(a), int(k)).to_pylist() for r, a, k in zip(row, start, length)]
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(op, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * keep_ids)


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
