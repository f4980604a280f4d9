"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic scale.

Each text becomes ``len(NAMES)`` statistics. Scaled to mean 0 and variance 1, they pass through ``FEATURES`` random
cosines whose inner products approximate a Gaussian kernel. Each partition of a bounded, seeded sample of labelled rows
(``SAMPLE_ROWS``) sums its share of the normal equations in fixed point, so the total doesn't depend on the order of
tasks; one ridge system of that fixed size is solved on the driver. A fold of the sample that the ridge didn't see
calibrates: pooled adjacent violators give a rising curve from ridge output to the share of label 1.

Cases: an empty or null text has all statistics 0 and gets that point's score. Labels other than 0 and 1, null ids
and the held-out fifth are not learned from; without usable labels all scores are 0.5. Each row of a repeated id is
scored, and one of them learned from. A statistic that never varies in the sample is ignored. Texts are read whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Staged, held_out, tidy
from ._labels import labelled_sample

SAMPLE_ROWS = 20_000
FEATURES = 192
RIDGE = 1e-3
PARTS = 8
_FIXED = float(1 << 24)
NAMES = (
    "log_words", "log_chars", "word_length", "word_spread", "longest_word", "distinct_words", "upper", "lower", "digits", "beyond_ascii", "white", "sentence_marks",
    "pauses", "shouts", "pipes", "symbols", "brackets", "quotes", "log_line_length", "repeated_lines", "short_words", "long_words", "capital_words",
)
_GROUPS = (range(65, 91), range(97, 123), range(48, 58), range(128, 256), (9, 10, 11, 12, 13, 32), b".?", b",;:", b"!", b"|", b"#$%&*+=@^~\\_<>", b"()[]{}", b"\"'`")
_MASKS = np.array([[b in g for b in range(256)] for g in map(set, _GROUPS)], float)


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    if not raw:
        return np.zeros(len(NAMES))
    share = _MASKS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    size = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    distinct = len(set(words)) / math.sqrt(n) if n else 0.0
    capital = sum(map(bytes.istitle, words)) / n if n else 0.0
    return np.array([
        math.log1p(n), math.log(len(raw)), size.mean(), size.std(), math.log1p(size.max()), distinct,
        *share, math.log(len(raw) / len(lines)), 1 - len(set(lines)) / len(lines), (size <= 3).mean(), (size >= 12).mean(), capital,
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift((x - self.mean) / self.scale, self.directions, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """To 9 digits, so that the last bits, which depend on how many rows are multiplied at once, don't show."""
        return np.round(np.clip(np.interp(np.round(self.raw(x), 9), self.knots, self.levels), 0.0, 1.0), 9)


def lift(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """A constant, and random cosines of points within 8 deviations."""
    z = np.cos(np.clip(x, -8, 8) @ directions + phases) * math.sqrt(2 / len(phases))
    return np.hstack([np.ones((len(x), 1)), z])


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: means of x and y of the blocks whose y means rise with x."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2] or blocks[-2][0] / blocks[-2][2] == blocks[-1][0] / blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    k = np.array(blocks)
    return k[:, 0] / k[:, 2], k[:, 1] / k[:, 2]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t).astype("<f8").tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "place"])


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f8").reshape(-1, len(NAMES))


def _summed(of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of of(points, labels) over the partition, in fixed point."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = of(_points(batch), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.rint(total * _FIXED).astype("<i8").tobytes()])], ["sums"])


def _total(rows: DataFrame, of) -> np.ndarray | None:
    got = [np.frombuffer(r[0], "<i8") for r in rows.mapInArrow(functools.partial(_summed, lambda x, y: of(x, y).ravel()), "sums binary").collect()]
    return sum(got[1:], got[0].copy()) / _FIXED if got else None


@tidy
def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """A model from at most ``rows`` labelled documents. The driver gets ``PARTS`` sums of fixed size, and the
    calibration fold's outputs and labels (a quarter of the rows)."""
    d = len(NAMES)
    sample = labelled_sample(docs, labels, label, rows, "rff", _measured)
    sample = Staged(sample.repartition(PARTS, "place").sortWithinPartitions("place", "x"), "quality").df
    fold = F.conv(F.substring("place", 1, 4), 16, 10).cast("int") % 4
    learn, check = sample.where(fold != 0).sortWithinPartitions("place", "x"), sample.where(fold == 0)
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(d, features)) / math.sqrt(d), rng.uniform(0, 2 * math.pi, features)
    neutral = Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    sums = _total(learn, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if sums is None:
        return neutral
    mean = sums[1 : d + 1] / sums[0]
    spread = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean**2, 0))
    scale = np.where(spread > 1e-6, spread, np.inf)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = lift((x - mean) / scale, directions, phases)
        return np.vstack([z.T @ z, z.T @ y])

    both = _total(learn, equations).reshape(features + 2, features + 1)
    penalty = np.eye(features + 1) * ridge * sums[0]
    penalty[0, 0] = 0
    weights = np.linalg.solve(both[:-1] + penalty + 1e-9 * np.eye(features + 1), both[-1])
    model = Model(mean, scale, directions, phases, weights, neutral.knots, neutral.levels)
    pairs = check.orderBy("place").select("x", "y").collect() or learn.orderBy("place").select("x", "y").collect()
    knots, levels = rising(model.raw(np.array([np.frombuffer(r[0], "<f8") for r in pairs])), np.array([float(r[1]) for r in pairs]))
    return Model(mean, scale, directions, phases, weights, knots, levels)


def _scores(shared, at: int, batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column(at).to_pylist()
    return shared.value.score(np.array([statistics(t) for t in texts])) if texts else np.empty(0)


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared, 1, batch), pa.float64())], ["doc_id", "score"])


def _keep(shared, at: int, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_scores(shared, at, batch) >= least))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", "text").mapInArrow(functools.partial(_score, shared), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at the threshold or above, with their own columns; the texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(functools.partial(_keep, shared, docs.columns.index("text"), threshold), docs.schema)
