"""Operator 1, quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of each whole text (shares of byte kinds, word lengths, repeated words and shingles) are transformed to smoothed
log-odds and logarithms, so that short texts move to the middle. Both classes get a mean and a covariance from sums that
Spark adds up over all labelled rows; each covariance is shrunk to the pooled one and then to a multiple of the identity.
The inverse Cholesky factors are computed once and sent with the task: a score is the difference of two Mahalanobis
log-densities and the log prior, through the logistic function.

Null and empty texts have statistics too (all counts 0) and get a score. If no rows of one class are labelled, every score
is the share of class 1 (0.5 without any). Labels other than 0 and 1 are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, written
from .labelled import held_out, training
from .words import shingles, word_hashes, word_spans

#: Shares of bytes, by kind.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "shout": b"!", "bar": b"|", "stop": b".,;:?",
         "symbol": b"#$%&*@^~<>=+_\\/{}[]", "line": b"\n", "space": b" \t", "other": bytes(range(128, 256))}
NAMES = [*KINDS, "length", "words", "word_length", "repeat", "distinct", "shingle_repeat", "marked"]
_KIND = np.zeros((len(KINDS), 256), bool)
for _i, _chars in enumerate(KINDS.values()):
    _KIND[_i, list(_chars)] = True
_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 44, 46]] = False


def odds(hits: np.ndarray, of: np.ndarray, prior: float = 2.0) -> np.ndarray:
    return np.log((hits + prior / 4) / (of - hits + prior))


def _repeats(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text, how many of its values it has had before."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = np.sort((values & np.uint64((1 << 44) - 1)) | (text << np.uint64(44)))
    again = np.flatnonzero(key[1:] == key[:-1])
    return np.bincount((key[again] >> np.uint64(44)).astype(np.int64), minlength=len(offsets) - 1).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    data, at = text_bytes(texts)
    n = np.diff(at).astype(float)
    counts = []
    for kind in _KIND:
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        counts.append((sums[at[1:]] - sums[at[:-1]]).astype(float))
    hashes, offsets = word_hashes(texts)
    words = np.diff(offsets).astype(float)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        equal = hashes[1:] == hashes[:-1]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(hashes))]
        equal[inner - 1] = False
        same[2:] = np.cumsum(equal)
    grams, gram_at = shingles(hashes, offsets)
    begin, end = word_spans(data, at) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    marked = np.concatenate([[0], np.cumsum(_MARK[data[end - 1]] if len(end) else np.zeros(0, bool), dtype=np.int64)])
    letters = n - counts[6] - counts[7]
    return np.column_stack([
        *(odds(c, n) for c in counts), np.log1p(n), np.log1p(words), np.log((letters + 10) / (words + 2)),
        odds((same[offsets[1:]] - same[offsets[:-1]]).astype(float), words), odds(_repeats(hashes, offsets), words),
        odds(_repeats(grams, gram_at), np.diff(gram_at).astype(float)), odds((marked[offsets[1:]] - marked[offsets[:-1]]).astype(float), words)])


def described(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics `x`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 2 << 20):
            x = statistics(b.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], ["doc_id", "x"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    share: float  # of class 1
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverse Cholesky factors of both covariances
    logs: np.ndarray | None = None  # half their log-determinants

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - g for m, f, g in zip(self.means, self.factors, self.logs, strict=True)]
        z = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: DataFrame, pooled: float, ridge: float) -> Discriminant:
    """rows: label, x. Sums of x and of its products come back as two rows of len(NAMES) ** 2 numbers."""
    d = len(NAMES)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, d + 1, d + 1))
        for f in frames:
            for k in (0, 1):
                if len(x := f.x[f.label == k]):
                    one = np.column_stack([np.ones(len(x)), np.stack(x)])
                    sums[k] += one.T @ one
        for k in (0, 1):
            yield pd.DataFrame({"label": k, "i": np.repeat(np.arange(d + 1), d + 1), "j": np.tile(np.arange(d + 1), d + 1), "v": sums[k].ravel()})

    total = np.zeros((2, d + 1, d + 1))
    parts = rows.mapInPandas(partial, "label int, i int, j int, v double")
    for r in parts.groupBy("label", "i", "j").agg(F.sum("v")).collect():
        total[r[0], r[1], r[2]] = r[3]
    n = total[:, 0, 0]
    if not n.all():
        return Discriminant(n[1] / n.sum() if n.sum() else 0.5)
    means = total[:, 0, 1:] / n[:, None]
    covs = total[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    both = np.tensordot(n / n.sum(), covs, 1)
    covs = (1 - pooled) * covs + pooled * both
    covs = (1 - ridge) * covs + ridge * np.trace(covs, axis1=1, axis2=2)[:, None, None] / d * np.eye(d) + 1e-9 * np.eye(d)
    lower = np.linalg.cholesky(covs)
    return Discriminant(n[1] / n.sum(), means, np.linalg.inv(lower), np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1))


def quality(docs: DataFrame, labels: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> DataFrame:
    """doc_id, held_out, score of each row. labels: doc_id, quality; pooled, ridge: the two shrinkages."""
    rows = written(described(docs), "quality")
    model = fit(rows.join(training(labels, "quality"), "doc_id").select("label", "x"), pooled, ridge)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x)) if len(x) else np.zeros(0))

    return rows.select("doc_id", held_out().alias("held_out"), score("x").alias("score"))
