"""Quality classifier (1): supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character n-grams of
each word (with word bounds), found by hashing into a fixed table, and of the word pair
"same word again", which has a row of its own; a softmax over two classes reads the mean. Both are trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, one_each, read, steps, texts_of, word_ids

BUCKETS = 1 << 18
GRAMS = (1, 2, 3)
DIMS = 16
EPOCHS = 4
RATE = 0.5
#: A mean spreads its gradient thin over many rows; their steps are this much longer.
SPREAD = 100
#: The row of the pair "same word again".
AGAIN = BUCKETS
#: Labelled rows the model is fitted on, at most.
MAX_TRAIN = 6_000
_MIX = np.random.default_rng(1).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def subwords(words: pa.Array, grams: tuple[int, ...] = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket): the hashed features of each word, the word itself first, then its n-grams."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.asarray(pc.utf8_length(words), dtype=np.int64) + 2
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - begin[word]
    # a word's own hash: a sum over its places, each with a weight of the place
    weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX[7]
    whole = np.add.reduceat((code + np.uint64(1)) * (weight ^ (weight >> np.uint64(29))) * _MIX[6], begin)
    ids, hashes = [np.arange(len(words))], [whole]
    left = size[word] - place
    for n in grams:
        at = np.flatnonzero(left >= n)
        key = np.full(len(at), np.uint64(n))
        for j in range(n):
            key = (key ^ (code[at + j] + np.uint64(1))) * _MIX[j]
            key ^= key >> np.uint64(31)
        ids.append(word[at])
        hashes.append(key)
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(33))) * _MIX[5]
    return np.concatenate(ids), ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def again(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them."""
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], ids[1:] == ids[:-1]])) if len(ids) else []]).astype(np.int64)
    begin, end = offsets[:-1], offsets[1:]
    return np.where(end > begin, same[end] - same[np.minimum(begin + 1, end)], 0)


@dataclass
class Model:
    vectors: np.ndarray  # (buckets + 1, dims); the last is AGAIN
    weights: np.ndarray  # (dims, 2)
    bias: np.ndarray  # (2,)

    def margins(self) -> np.ndarray:
        """The share of each bucket in the difference of the two logits.

        The mean of vectors times the softmax weights is the mean of these numbers, so a
        document needs no vector arithmetic.
        """
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, buckets: int = BUCKETS, seed: int = 1) -> Model:
    """Trained on (label, buckets, counts) of documents, one document a step."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dims, 1 / dims, (buckets + 1, dims)).astype(np.float32)
    w, b = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    todo, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, idx, share = rows[i]
            if not len(idx):
                continue
            lr = rate * (1 - done / todo)
            done += 1
            own = e[idx]
            mean = share @ own
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= lr * np.outer(mean, p)
            b -= lr * p
            e[idx] = own - (lr * SPREAD) * share[:, None] * back
    return Model(e, w, b)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """A model fitted on at most `most` labelled documents outside the held-out fifth, one row of each doc_id.

    No label, or one class only: every document gets the smoothed share of label 1.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                offsets, ids, words = word_ids(texts_of(part))
                of, bucket = subwords(words)
                order = np.argsort(of, kind="stable")
                bucket, ends = bucket[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
                out, same = [], again(ids, offsets)
                for i in range(part.num_rows):
                    own, times = np.unique(ids[offsets[i] : offsets[i + 1]], return_counts=True)
                    many = ends[own + 1] - ends[own]
                    at = np.repeat(ends[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    feats, where = np.unique(bucket[at], return_inverse=True)
                    count = np.bincount(where, np.repeat(times, many), len(feats))
                    if same[i]:
                        feats, count = np.append(feats, AGAIN), np.append(count, same[i] * count.sum() / times.sum())
                    out.append((feats.astype(np.int32).tobytes(), count.astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["doc_id", "label", "idx", "cnt"])

    sample = bounded_sample(labels, "quality", most)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = one_each(picked.mapInArrow(op, "doc_id bigint, label int, idx binary, cnt binary"))
    found = sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    rows = []
    for _, y, idx, cnt in found:
        c = np.frombuffer(cnt, np.float32)
        rows.append((int(y > 0), np.frombuffer(idx, np.int32), c / max(c.sum(), 1)))
    ones = sum(y for y, _, _ in rows)
    if not rows or ones in (0, len(rows)):
        p = (ones + 1) / (len(rows) + 2)
        return Model(np.zeros((BUCKETS + 1, 1), np.float32), np.zeros((1, 2), np.float32), np.array([0, np.log(p / (1 - p))], np.float32))
    return fit(rows)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    score: probability of label 1 from the whole text. A null or empty text has no
    features and gets the score of the bias alone. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = shared.value
        for batch in batches:
            for part in steps(batch):
                offsets, ids, words = word_ids(texts_of(part))
                of, bucket = subwords(words)
                total, count = np.bincount(of, margin[bucket], len(words)), np.bincount(of, minlength=len(words))
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                size = np.maximum(np.bincount(doc, count[ids], part.num_rows), 1)
                share = again(ids, offsets) / np.maximum(np.diff(offsets), 1)
                z = (np.bincount(doc, total[ids], part.num_rows) / size + share * margin[AGAIN]) / (1 + share) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(op, "doc_id bigint, held_out boolean, score double, predicted int")


def op1_quality_subword(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
