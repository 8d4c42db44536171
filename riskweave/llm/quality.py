"""Document quality by a regularised quadratic discriminant over text statistics.

Every text becomes a vector of transformed statistics (logarithms of lengths, square roots of
shares). For both label values the mean and covariance of the labelled training rows are summed in
the tasks, so the whole training set counts and only one small matrix per task is shuffled. A class
covariance is shrunk in two steps, towards the pooled covariance (SHRINK) and towards its own mean
variance (RIDGE), which keeps it positive definite. The score is the posterior of label 1: a logistic
function of the difference of the two Gaussian log densities, i.e. Mahalanobis distances and log
determinants from the Cholesky factors that the model keeps, divided by a temperature.

Only the text enters the score. Training rows are those with a label and whose crc32(doc_id as text)
mod 5 is not 0.

Defined cases: a null text counts as empty and is scored like one. A row without doc_id has no label,
is held out false and is scored. Rows that repeat a doc_id are scored one by one; a doc_id with
several label rows counts once for each. Null labels are ignored. If a class has no training rows,
every score is the share of label 1 (0.5 without any label). An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import rules, text
from riskweave.session import materialise

SHRINK, RIDGE = 0.1, 0.02
#: Statistics are not independent given the class, so the log-density difference is damped.
TEMPERATURE = 3.0
THRESHOLD = 0.3
FOLDS = 5


def _marked(*letters: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(b"".join(letters))] = True
    return mask


_UPPER = _marked(bytes(range(65, 91)))
_DIGIT = _marked(b"0123456789")
_STOP = _marked(b".?")
_COMMA = _marked(b",;:")
_PIPE = _marked(b"|")
_BANG = _marked(b"!")
_OTHER = _marked(b"#*$%&<>@=_/\\{}[]~^")
_HIGH = np.arange(256) >= 0xC0
FEATURES = ("log_words", "word_length", "upper", "digits", "stops", "commas", "pipes", "bangs",
            "others", "accents", "repeat", "dup_lines", "top_word", "distinct", "line_words")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float64 array (texts, FEATURES) of the transformed statistics."""
    part = rules.Slice(data, offsets)
    words = part.stat("n_words").astype(float)
    some = np.maximum(words, 1)
    chars = np.maximum(part.stat("word_chars").astype(float), 1)
    lines = np.maximum(part.stat("n_lines").astype(float), 1)
    share = lambda mask, base: np.sqrt(part._count(mask[data]) / base)
    first, hashed = part._spans()[2], part._hashes()
    order = np.lexsort((hashed, text.owners(first)))
    row = text.owners(first)
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=len(part))
    return np.stack([
        np.log1p(words), np.log(chars / some), share(_UPPER, chars), share(_DIGIT, chars),
        share(_STOP, some), share(_COMMA, some), share(_PIPE, some), share(_BANG, some),
        share(_OTHER, some), share(_HIGH, chars),
        np.sqrt(part.stat("n_repeat_words") / some), np.sqrt(part.stat("n_dup_lines") / lines),
        np.sqrt(part.stat("top_word") / some),
        np.log(np.maximum(distinct, 1)) - 0.8 * np.log(some), np.log1p(words / lines)], axis=1)


@dataclass
class Model:
    """Means, Cholesky factors of the inverse covariances and log densities' constants."""
    means: np.ndarray | None
    factors: np.ndarray | None
    constants: np.ndarray | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for every row."""
        if self.means is None:
            return np.full(len(x), self.share)
        log_density = [c - 0.5 * (((x - m) @ f) ** 2).sum(axis=1)
                       for m, f, c in zip(self.means, self.factors, self.constants)]
        odds = np.clip((log_density[1] - log_density[0]) / TEMPERATURE, -500, 500)
        prior = np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-(odds + prior)))


def fit(count: np.ndarray, total: np.ndarray, cross: np.ndarray) -> Model:
    """Model from the counts, sums and cross products of both classes."""
    if not count.all():
        return Model(None, None, None, float(count[1] / count.sum()) if count.sum() else 0.5)
    means = total / count[:, None]
    own = np.stack([c / n - np.outer(m, m) for c, n, m in zip(cross, count, means)])
    pooled = np.tensordot(count / count.sum(), own, axes=1)
    width = len(pooled)
    # scale-free ridge: in units of each statistic's pooled variance
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, constants = [], []
    for c in own:
        c = ((1 - SHRINK) * c + SHRINK * pooled) / np.outer(scale, scale)
        c = (1 - RIDGE) * c + RIDGE * max(np.trace(c) / width, 1e-6) * np.eye(width)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower).T / scale[:, None])
        constants.append(-np.log(np.diag(lower)).sum())
    return Model(means, np.stack(factors), np.array(constants), float(count[1] / count.sum()))


def _measured(batches):
    for batch in batches:
        for row, data, offsets in text.slices(batch.column(1)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(x)),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                 .cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def _moments(batches):
    d = len(FEATURES)
    count, total, cross = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        x, label = _matrix(batch.column("x")), batch.column("label").to_numpy()
        for k in (0, 1):
            own = x[label == k]
            count[k] += len(own)
            total[k] += own.sum(axis=0)
            cross[k] += own.T @ own
    yield pa.RecordBatch.from_arrays(
        [pa.array([pickle.dumps((count, total, cross))], pa.binary())], names=["m"])


def _merged(batches):
    parts = [pickle.loads(m.as_py()) for batch in batches for m in batch.column(0)]
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(tuple(map(sum, zip(*parts))))], pa.binary())], names=["m"])


def train(measured: DataFrame, labels: DataFrame) -> Model:
    """Model of the labelled training rows among (doc_id, x)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("quality").cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)")
             .where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    parts = (measured.join(known, "doc_id").select("x", "label")
             .mapInArrow(_moments, "m binary"))
    # one matrix per task, merged by a few tasks before the driver sees them
    sums = [pickle.loads(r["m"]) for r in
            parts.repartition(4).mapInArrow(_merged, "m binary").collect()]
    d = len(FEATURES)
    zero = (np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)))
    return fit(*map(sum, zip(zero, *sums)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    measured = materialise(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_measured, "doc_id long, x array<double>"), "statistics")
    model = train(measured, labels)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return measured.mapInArrow(run, "doc_id long, score double, predicted int").select(
        "doc_id", held.alias("held_out"), "score", "predicted")
