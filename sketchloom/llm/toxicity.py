"""Toxicity (2): cumulative-link ordinal regression on sparse text features.

One weight vector serves all ordered thresholds: P(grade > k) = sigmoid(w . x - cut[k]).
Features are a document's words and word starts, lower-cased and stripped of marks, of
which training keeps those that speak for toxicity beyond chance. A document's features
weigh one over the root of their number, so that many do not drown the word that tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, one_each, read, steps, texts_of, word_ids, written

#: Labelled rows the model is fitted on, at most, and features it keeps, at most: those with the largest z.
MAX_TRAIN, MAX_FEATURES = 20_000, 2_000
PREFIXES = (3, 4, 6)
GRADES = 3
#: Standard deviations that a feature's share in toxic texts lies above its share in all.
LEAST_Z = 5.0


def tokens(words: pa.Array) -> pa.Array:
    """Words in lower case, without marks at both ends."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\pL\pN]+|[^\pL\pN]+$", "")


def features(words: pa.Array) -> list[tuple[np.ndarray, pa.Array]]:
    """(word, feature) lists: the whole word ("=word") and its starts ("^start") of each length of PREFIXES."""
    t = tokens(words)
    size = np.asarray(pc.utf8_length(t))
    full = np.flatnonzero(size > 0)
    out = [(full, pc.binary_join_element_wise(pa.scalar("=", t.type), t.take(pa.array(full)), pa.scalar("", t.type)))]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        out.append((at, pc.binary_join_element_wise(pa.scalar("^", t.type), pc.utf8_slice_codeunits(t.take(pa.array(at)), 0, n), pa.scalar("", t.type))))
    return out


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 40.0))
    toxic_at: float = 0.5  # the least P(grade > 0) of a toxic text

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 400, ridge: float = 1e-4, rate: float = 0.5) -> Model:
    """Ordinal regression by gradient ascent (Adam) on the cumulative-link likelihood.

    Cuts are kept in order by their first value and the logarithms of their steps.
    """
    n, k = len(y), GRADES - 1
    par = np.zeros(x.shape[1] + k)
    share = np.clip([(y > j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    par[-k] = start[0]
    par[-k + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, rounds + 1):
        cuts = par[-k] + np.concatenate([[0], np.cumsum(np.exp(par[-k + 1 :]))])
        p = 1 / (1 + np.exp(-np.clip((x @ par[:-k])[:, None] - cuts[None, :], -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        like = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-12)
        slope = np.zeros((n, k + 2))
        slope[:, 1:-1] = p * (1 - p)
        dz = (slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / like
        dcut = np.zeros(k)
        for j in range(k):
            dcut[j] = (-(slope[:, j + 1] / like) * (y == j + 1) + (slope[:, j + 1] / like) * (y == j)).sum() / n
        g = np.concatenate([x.T @ dz / n - ridge * par[:-k], [dcut.sum()], [dcut[j:].sum() * np.exp(par[-k + j]) for j in range(1, k)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par += rate * 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = par[-k] + np.concatenate([[0], np.cumsum(np.exp(par[-k + 1 :]))])
    return Model(names, par[:-k], cuts)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_features: int = MAX_FEATURES, least_z: float = LEAST_Z) -> Model:
    """A model fitted on at most `most` labelled documents outside the held-out fifth.

    Grades come from the labels alone: labels.grade (0 to GRADES - 1) where there is one,
    else 0 for a document that is not toxic, 1 for a toxic one and 2 for a toxic one that is
    labelled of low quality as well. Kept are the `most_features` features with the largest z of
    least_z or more; of a doc_id with several rows or labels one is used. Without both toxic and other documents the model finds
    nothing toxic.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                offsets, ids, words = word_ids(texts_of(part))
                owned: list[list[str]] = [[] for _ in range(len(words))]
                for at, names in features(words):
                    for w, name in zip(at.tolist(), names.to_pylist()):
                        owned[w].append(name)
                out = [sorted({f for w in np.unique(ids[offsets[i] : offsets[i + 1]]) for f in owned[w]}) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "label", "names"])

    low = F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int") if "quality" in labels.columns else F.lit(0)
    grade = F.greatest(F.lit(0), F.least(F.col("grade"), F.lit(GRADES - 1))) if "grade" in labels.columns else F.when(F.col("toxic") > 0, 1 + low).when(F.col("toxic") <= 0, 0)
    sample = bounded_sample(labels.select("doc_id", grade.alias("grade")), "grade", most)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    seen = written(one_each(picked.mapInArrow(op, "doc_id bigint, label int, names array<string>")), "features")
    bad = (F.col("label") > 0).cast("int")
    n = seen.agg(F.count("*"), F.sum(bad)).first()
    if not n[0] or not n[1] or n[0] == n[1]:
        return Model()
    share = n[1] / n[0]
    counts = seen.select("label", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("all"), F.sum(bad).alias("bad"))
    z = (F.col("bad") - F.col("all") * share) / F.sqrt(F.col("all") * share * (1 - share))
    told = counts.withColumn("z", z).where(F.col("z") >= least_z).where(F.col("bad") >= F.col("all") * max(0.5, share)).orderBy(F.desc("z"), "name").limit(most_features).collect()
    names = [r["name"] for r in told]
    if not names:
        return Model()
    wanted = F.array(*[F.lit(x) for x in names])
    rows = seen.select("doc_id", "label", F.array_intersect("names", wanted).alias("names")).collect()
    rows = sorted((r[0], r[1], tuple(r[2])) for r in rows)
    place = {x: j for j, x in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r[2]]] = 1
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    toxic = np.array([r[1] > 0 for r in rows])
    model = fit(x, np.array([r[1] for r in rows]), names)
    p = model.above(x @ model.weights)[:, 0]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(toxic[order])
    f1 = 2 * right / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0  # no cut between equal scores
    k = int(f1.argmax())
    model.toxic_at = float((p[order][k] + p[order][min(k + 1, len(p) - 1)]) / 2)
    return model


def grades(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, toxic, p_toxic) of every row.

    severity: the expected grade, the sum of P(grade > k); grade: the likeliest; toxic:
    P(grade > 0) is at least the cut with the best F1 in training. A null or empty text has no features. Repeated rows are graded
    alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = pa.array(model.names, pa.large_string())
        for batch in batches:
            for part in steps(batch):
                offsets, ids, words = word_ids(texts_of(part))
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                z = np.zeros(part.num_rows)
                hits = []
                for at, names in features(words):
                    f = np.asarray(pc.fill_null(pc.index_in(names.cast(pa.large_string()), known), -1))
                    of = np.full(len(words), -1)
                    of[at] = f
                    told = of[ids]
                    on = told >= 0
                    hits.append(np.stack([doc[on], told[on]], 1))
                pairs = np.unique(np.concatenate(hits), axis=0)  # a feature counts once a document
                np.add.at(z, pairs[:, 0], model.weights[pairs[:, 1]] if len(pairs) else 0.0)
                z /= np.maximum(np.sqrt(np.bincount(pairs[:, 0], minlength=part.num_rows)), 1)
                p = model.above(z)
                whole = np.concatenate([np.ones((len(z), 1)), p, np.zeros((len(z), 1))], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(1)), pa.array((whole[:, :-1] - whole[:, 1:]).argmax(1).astype(np.int32)), pa.array(p[:, 0] >= model.toxic_at), pa.array(p[:, 0])], names=["doc_id", "severity", "grade", "toxic", "p_toxic"])

    return docs.select("doc_id", "text").mapInArrow(op, "doc_id bigint, severity double, grade int, toxic boolean, p_toxic double")


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return grades(docs, train(docs, read(spark, sf_dir, "labels")))
