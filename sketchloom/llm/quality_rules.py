"""Quality rules (10): boosted trees over document statistics, after two fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boost
from .common import beside, bounded_sample, one_each, read, steps, texts_of, word_ids

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Labelled rows the trees are fitted on, at most.
MAX_TRAIN = 20_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "exclaims", "punctuation", "distinct", "line_words", "pipes", "short", "non_ascii", "capitals")
#: Quality may only fall as these rise.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbols", "dup_lines", "repeats", "upper", "exclaims", "pipes")}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_WEIGHTS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(ids: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each text, the words that lie in a window found twice or more in it; text i has the word ids offsets[i] .. offsets[i + 1]."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(len(ids)) + window <= offsets[1:][doc])  # windows that end in their text
    u = ids.astype(np.uint64) + np.uint64(1)
    key = (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(window):
        key += u[at + j] * _WEIGHTS[j % WINDOW]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    maybe = np.zeros(len(at), bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = at[maybe]  # equal keys are only likely to be equal windows: compare the words
    cover = np.zeros(len(ids) + 1, np.int64)
    if len(at):
        rows = np.concatenate([doc[at][:, None], np.lib.stride_tricks.sliding_window_view(ids, window)[at]], axis=1)
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = at[counts[inverse.ravel()] > 1]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return inside[offsets[1:]] - inside[offsets[:-1]]


def _distinct(doc: np.ndarray, item: np.ndarray, many: int) -> np.ndarray:
    """The different items of each of `many` texts."""
    if not len(item):
        return np.zeros(many, np.int64)
    top = int(item.max()) + 1
    pairs = np.sort(doc * top + item)
    return np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] // top, minlength=many)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(base, features) of each text: the columns BASE (int64) and FEATURES (float64), counted over all texts at once."""
    many = len(texts)
    offsets, ids, words = word_ids(texts)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(many), n)
    length = np.asarray(pc.utf8_length(words), dtype=np.int64)
    first = np.asarray(pc.utf8_is_upper(pc.utf8_slice_codeunits(words, 0, 1)), dtype=bool)
    per = lambda weight: np.bincount(doc, weight[ids], many)
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + many + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    full_texts = np.flatnonzero(np.diff(ends))

    def count(these: bytes) -> np.ndarray:
        on = np.zeros(256, bool)
        on[list(these)] = True
        out = np.zeros(many, np.int64)
        if len(data):
            out[full_texts] = np.add.reduceat(on[data], ends[:-1][full_texts] - ends[0], dtype=np.int64)
        return out

    lists = pc.split_pattern(texts, "\n")
    flat, cuts = lists.flatten(), np.asarray(lists.offsets, np.int64)
    line_doc = np.repeat(np.arange(many), np.diff(cuts))
    full = np.asarray(pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0), dtype=bool)
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    lines = np.bincount(line_doc[full], minlength=many)
    dups = lines - _distinct(line_doc[full], np.asarray(coded.indices, dtype=np.int64), many)
    chars, symbols, repeats = per(length).astype(np.int64), count(SYMBOLS), repeated_words(ids, offsets)
    base = np.stack([n, chars, symbols, dups, repeats], 1)
    size, one, row = np.diff(ends), np.maximum(n, 1), np.maximum(lines, 1)
    feats = np.stack(
        [
            np.log1p(n), chars / one, symbols / one, dups / row, repeats / one, count(_LETTERS[:26]) / np.maximum(count(_LETTERS), 1), count(b"0123456789") / one, count(b"!") / one,
            count(b".,;:?'\"()-") / one, _distinct(doc, ids, many) / one, n / row, count(b"|") / one, per(length <= 3) / one, 1 - np.asarray(pc.utf8_length(texts), dtype=np.int64) / np.maximum(size, 1), per(first) / one,
        ],
        1,
    )
    feats[n == 0] = 0
    return base.astype(np.int64), feats


def features_of(docs: DataFrame) -> DataFrame:
    """(doc_id, label, x) of labelled documents; x: the features as an array."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                _, x = statistics(texts_of(part))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return docs.select("doc_id", "label", "text").mapInArrow(op, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> boost.Trees:
    """Trees fitted on at most `most` labelled documents outside the held-out fifth, one row of each doc_id.

    No label, or one class only: a model that keeps every document.
    """
    sample = bounded_sample(labels, "quality", most)
    rows = one_each(features_of(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))).collect()
    y = np.array([r["label"] > 0 for r in rows], float)
    if not rows or y.min() == y.max():
        return boost.constant(0.999)
    x = np.array([r["x"] for r in rows])
    order = np.lexsort([*x.T, y])  # rows come back in any order
    return boost.fit(x[order], y[order], MONOTONE)


def judge(docs: DataFrame, model: boost.Trees, threshold: float = 0.5) -> DataFrame:
    """docs and, for each row: BASE, base_failed, score (0 to 1) and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows.
    kept: not base_failed and score >= threshold. A null or empty text has no words and
    fails. Repeated rows are judged alike, each on its own. Columns of docs with a name
    of the result's are replaced.
    """
    schema = docs.drop(*BASE, "base_failed", "score", "kept")
    names = [*BASE, "base_failed", "score", "kept"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                base, x = statistics(texts_of(part))
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                score = shared.value.score(x)
                kept = ~failed & (score >= threshold)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(base[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(kept)], names=[*part.schema.names, *names])

    out = T.StructType([*schema.schema.fields, *(T.StructField(b, T.LongType()) for b in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return schema.mapInArrow(op, out)


def passing(docs: DataFrame, model: boost.Trees) -> DataFrame:
    """The rows of docs that are kept, with all columns of docs as they are."""
    rest, back = beside(docs, "text")
    return judge(docs.select("text", *rest), model).where("kept").select(*[back(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), model).select("doc_id", *BASE, "base_failed", "kept", "score")
