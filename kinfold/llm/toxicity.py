"""Toxicity by non-negative positive-unlabelled learning (operator 3).

Confirmed toxic rows are the positives; a draw from all training texts, whatever their label, is unlabelled. A linear numpy
classifier over the presence of word and word-prefix features minimises the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss (Kiryo et al. 2017): when the second term falls below zero, its gradient is followed upwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import U64, Hasher, column_bytes, distinct, lowered, slices, spans

#: The classifier is fitted on at most so many rows of either kind, those of least hash.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12_000
#: At most so many features get a weight: those met in most positives, then those that tell most.
MAX_CANDIDATES, MAX_FEATURES = 60_000, 4000
#: Least estimated odds of toxic texts among those with a feature.
EVIDENCE = 0.7
#: Bytes of the word prefixes that count as features beside the word itself; they catch inflected forms.
PREFIXES = (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, with repeats."""
    texts = column_bytes(batch.column(text))
    data = lowered(texts.data)
    start, end, doc = spans(_LETTER[data], texts.offsets)
    h = Hasher(data)
    docs, out = [doc], [h.ranges(start, end)]
    for n in PREFIXES:
        longer = end - start > n
        docs.append(doc[longer])
        out.append(h.ranges(start[longer], start[longer] + n) ^ U64(n))
    return np.concatenate(docs), np.concatenate(out)


@dataclass
class Model:
    """Weights of the features (sorted hashes) and the bias; ``table`` narrows a look-up to the few hashes that may match."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of the feature) without repeats."""
        row, h = features(batch, text)
        maybe = self.table[(h & U64((1 << 20) - 1)).astype(np.int64)]
        row, h = row[maybe], h[maybe]
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        ok = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        row, at = distinct(row[ok], at[ok].astype(U64))
        return row, at.astype(np.int64)

    def scores(self, batch: pa.RecordBatch, text: str) -> np.ndarray:
        row, at = self.hits(batch, text)
        z = self.bias + np.bincount(row, weights=self.weights[at], minlength=batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu(row: np.ndarray, column: np.ndarray, positive: np.ndarray, n_columns: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative PU risk; the matrix is given by the places of its ones."""
    n, n_p = len(positive), max(int(positive.sum()), 1)
    n_u = max(n - n_p, 1)
    w, b = np.zeros(n_columns), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[column], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        softplus = np.logaddexp(0, z)  # the loss of calling the row negative
        rest = softplus[~positive].sum() / n_u - prior * softplus[positive].sum() / n_p
        d_rest = np.where(positive, -prior * s / n_p, s / n_u)
        d = np.where(positive, prior * (s - 1) / n_p, 0.0) + d_rest if rest >= 0 else -d_rest
        g = np.append(np.bincount(column, weights=d[row], minlength=n_columns) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model learnt from the rows of ``docs`` for which ``learn`` holds; None without a confirmed toxic one.

    The unlabelled sample is drawn from all of them, positives too, as the risk has it. An id with labels that differ counts
    as toxic; rows that repeat an id are all taken; ties in the sample's hash go to the lower id; null ids aren't learnt from.
    Only bounded things come to the driver: the candidate features and the weights. The sample is fitted in one task.
    """
    marks = labels.groupBy(id_col).agg(F.max(label).alias("_y"))
    rows = docs.filter(learn).select(id_col, text)
    ids = rows.select(id_col).filter(F.col(id_col).isNotNull()).distinct().join(marks, id_col, "left")
    order = F.xxhash64(id_col, F.lit(3))
    chosen = [ids.filter(kind).select(id_col, F.lit(p).alias("_p")).orderBy(order, id_col).limit(most) for p, kind, most in ((1, F.col("_y") == 1, MAX_POSITIVE), (0, F.lit(True), MAX_UNLABELLED))]
    share = ids.agg(F.avg(F.when(F.col("_y").isNotNull(), (F.col("_y") == 1).cast("double"))).alias("share"), F.avg((F.col("_y") == 1).cast("double"))).first()["share"]
    if not share:
        return None
    prior = min(max(share, 0.01), 0.5)
    sample = rows.join(F.broadcast(chosen[0].union(chosen[1])), id_col).select("_p", text)  # at most 16,000 ids

    def count(batches):
        for b in slices(batches, text):
            _, h = distinct(*features(b, text))
            keys, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])

    n_positive = sample.filter("_p = 1").count()
    least = max(3, int(0.002 * n_positive))
    counted = sample.filter("_p = 1").select(text).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    keys = np.sort(np.asarray(counted.orderBy(F.desc("n"), "feature").limit(MAX_CANDIDATES).select("feature").toArrow().column(0)).astype(np.int64).view(U64))
    if not len(keys):
        return None
    candidates = Model(keys, np.zeros(len(keys)), 0.0)

    def places(batches):
        for b in slices(batches, text):
            row, at = candidates.hits(b, text)
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("_p"), pa.array([x.astype(np.uint16).tobytes() for x in np.split(at, np.cumsum(n)[:-1])], pa.binary())], ["p", "at"])

    def fit(table: pa.Table) -> pa.Table:
        """The whole of the bounded sample in one task: features are chosen, then weighted. The bias has no feature."""
        marks = sorted(zip(table.column("p").to_pylist(), table.column("at").to_pylist(), strict=True))
        positive = np.array([p == 1 for p, _ in marks])
        size = np.array([len(at) // 2 for _, at in marks])
        column = np.frombuffer(b"".join(at for _, at in marks), np.uint16)
        row = np.repeat(np.arange(len(marks), dtype=np.int32), size)
        in_p = np.bincount(column[positive[row]], minlength=len(keys))
        in_u = np.bincount(column, minlength=len(keys)) - in_p
        # By Bayes, prior * p / u is the share of toxic texts among those with the feature; keep what points to toxic ones.
        # u is drawn from all texts, so it holds the toxic ones too.
        p, u = (in_p + 0.5) / (positive.sum() + 1), (in_u + 1.0) / ((~positive).sum() + 1)
        gain = np.where(prior * p / u >= EVIDENCE / (1 + EVIDENCE), in_p * np.log(p / u), -1.0)
        kept = np.argsort(-gain, kind="stable")[:MAX_FEATURES]
        kept = np.sort(kept[gain[kept] > 0])
        place = np.full(len(keys), -1)
        place[kept] = np.arange(len(kept))
        ok = place[column] >= 0
        w, b = nnpu(row[ok], place[column[ok]], positive, len(kept), prior)
        return pa.table({"feature": pa.array([*keys[kept].view(np.int64).tolist(), None], pa.int64()), "weight": pa.array([*w.tolist(), b], pa.float64())})

    grouped = sample.mapInArrow(places, "p int, at binary").withColumn("all", F.lit(0)).groupBy("all")
    fitted = grouped.applyInArrow(fit, "feature long, weight double").collect()  # MAX_FEATURES + 1 rows at most
    found = sorted((np.int64(r["feature"]).view(U64), r["weight"]) for r in fitted if r["feature"] is not None)
    if not found:
        return None
    bias = next(r["weight"] for r in fitted if r["feature"] is None)
    return Model(np.array([f for f, _ in found], U64), np.array([w for _, w in found]), float(bias))


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the probability of being toxic; 0 without a model. A null text scores as an empty one."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0)).drop(*([] if keep_text else [text]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    out = kept if keep_text else [c for c in kept if c != text]

    def run(batches):
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(held.value.scores(b, text))], [*out, name])

    return docs.select(*kept).mapInArrow(run, docs.select(*out).schema.add(name, "double"))
