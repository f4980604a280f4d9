"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 32-bit hashes of a text's words, adjacent pairs, and pairs with one word between; words also enter cut to
their stems, which carries over to inflected forms that the labels don't show. Each counts once a text. Training goes
through a bounded sample of labelled rows (``SAMPLE_ROWS``, by a seeded hash of the id, and ``SAMPLE_FEATURES``) in one
task, in hash order, ``EPOCHS`` times. Each coordinate has a learning rate of its own, and the L1 term leaves few weights,
which are broadcast sorted by hash: at most as many as the sample has features, in practice some thousands. Scoring
covers each whole text, one at a time, in any number of partitions.

Cases: a null or empty text scores the bias alone. Labels other than 0 and 1, null ids and the held-out fifth are not
learned from, nor are texts of more than ``TEXT_FEATURES`` features. Several rows of one id are scored each, and one of
them is learned from. Without a usable label all scores are 0.5 and nothing is
predicted toxic. Tables may have other columns.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Staged, held_out, tidy
from ._labels import labelled_sample

SAMPLE_ROWS = 8_000
#: Hashes that the sample holds at most (96 MB), and the most that one text may have to be learned from.
SAMPLE_FEATURES, TEXT_FEATURES = 24_000_000, 2_000_000
EPOCHS = 5
#: Lengths to which longer words are cut for features of their stems, and how many words make a stem frequent.
STEMS, MANY = (4, 5, 6, 7), 3
ASCII_EDGES = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
MIN = 4
_KEPT = 100_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ftrl:
    """Defaults by cross-validation over rows that labels are learned from: large steps against a strong L1 term."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0


@dataclass(frozen=True)
class Weights:
    """Sorted 32-bit feature hashes, their weights, the bias, and a map of the hashes' upper 16 bits."""

    keys: np.ndarray
    values: np.ndarray
    bias: float
    upper: np.ndarray

    def score(self, features: np.ndarray) -> float:
        x = self.bias
        if len(self.keys):
            near = features[self.upper[features >> np.uint32(16)]]
            at = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
            x += float(self.values[np.unique(at[self.keys[at] == near])].sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class _WordHash(dict):
    """Word to its hash, 0 for bare punctuation; stems: hash to the hashes of its stems."""

    def __init__(self):
        self.stems: dict[int, bytes] = {}

    def __missing__(self, word: str) -> int:
        bare = word.strip(ASCII_EDGES)
        value = self[word] = xxhash.xxh3_64_intdigest(bare.encode()) if bare else 0
        self.stems[value] = np.array([xxhash.xxh3_64_intdigest(f"{bare[:k]}-".encode()) for k in STEMS if len(bare) > k], "<u8").tobytes()
        return value


def features(text: str | None, known: _WordHash) -> np.ndarray:
    """Hashes of words (cut at white space, bare of ASCII punctuation around), their stems, pairs and skip-pairs; with
    repeats. A stem that ``MANY`` different words of the text share gives one more."""
    if len(known) > _KEPT:  # never amid a text: the memory holds as many words, and those of one text
        known.clear()
        known.stems.clear()
    words = (text or "").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h = h[h != 0]
    pair = h[:-1] * _P + h[1:]
    skip = h[:-2] * _Q + h[2:] * _P
    once = dict.fromkeys(h.tolist())
    stems, seen = np.unique(np.frombuffer(b"".join(map(known.stems.__getitem__, once)), "<u8"), return_counts=True)
    x = np.concatenate([h, pair, skip, stems, stems[seen >= MANY] + _Q])
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        x = [np.unique(features(t, known)).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "place"])


def train(rows: list[np.ndarray], labels: list[int], how: Ftrl, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys and values of the weights that aren't 0, and the bias. Features of fewer than ``MIN`` rows are left out."""
    if not rows:
        return np.empty(0, np.uint32), np.empty(0), 0.0
    keys, counts = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[counts >= MIN]
    index = []
    for r in rows:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
            index.append(at[keys[at] == r].astype(np.int32))
        else:
            index.append(np.empty(0, np.int32))
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    bias, bias_n = math.log(share / (1 - share)), 0.0
    weights = lambda z, n: np.where(np.abs(z) <= how.l1, 0.0, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))
    for _ in range(epochs):
        for at, y in zip(index, labels, strict=True):
            za, na = z[at], n[at]
            w = weights(za, na)
            g = 1 / (1 + math.exp(-max(-40.0, min(40.0, bias + w.sum())))) - y
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / how.alpha * w
            n[at] = na + g * g
            bias_n += g * g
            bias -= 0.02 * g / (1 + math.sqrt(bias_n))
    w = weights(z, n)
    return keys[w != 0], w[w != 0], bias


def _train(how: Ftrl, epochs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        rows += [np.frombuffer(x, np.uint32) for x in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    if rows:
        keys, values, bias = train(rows, labels, how, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([keys.astype("<u4").tobytes()]), pa.array([values.astype("<f8").tobytes()]), pa.array([bias])], ["keys", "weights", "bias"])


def _last_place(sizes: list[tuple[str, int]], most: int) -> str:
    """The last place at which the sample, in order, holds no more than ``most`` features."""
    last, total = "", 0
    for place, n in sorted(sizes):
        total += n
        if total > most:
            break
        last = place
    return last


@tidy
def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, how: Ftrl = Ftrl(), epochs: int = EPOCHS, features: int = SAMPLE_FEATURES, text_features: int = TEXT_FEATURES) -> Weights:
    """Weights from at most ``rows`` labelled documents, of at most ``text_features`` features each and ``features`` in
    all. Only the sample's hashes go to the training task, and one number for each of its rows to the driver."""
    sample = Staged(labelled_sample(docs, labels, label, rows, "ftrl", _featured), "toxicity").df.where(F.octet_length("x") <= 4 * text_features)
    sizes = [(r[0], r[1] // 4) for r in sample.select("place", F.octet_length("x")).collect()]
    one = sample.where(F.col("place") <= _last_place(sizes, features)).repartition(1).sortWithinPartitions("place", "x")
    got = one.mapInArrow(functools.partial(_train, how, epochs), "keys binary, weights binary, bias double").collect()
    keys, values, bias = (np.frombuffer(got[0][0], "<u4"), np.frombuffer(got[0][1], "<f8"), got[0][2]) if got else (np.empty(0, "<u4"), np.empty(0), 0.0)
    upper = np.zeros(1 << 16, bool)
    upper[keys >> np.uint32(16)] = True
    return Weights(keys, values, bias, upper)


def _scores(shared, at: int, batch: pa.RecordBatch, known: dict) -> list[float]:
    weights: Weights = shared.value
    return [weights.score(features(t, known)) for t in batch.column(at).to_pylist()]


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared, 1, batch, known), pa.float64())], ["doc_id", "score"])


def _keep(shared, at: int, below: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        yield batch.filter(pa.array([s < below for s in _scores(shared, at, batch, known)], pa.bool_()))


def score(docs: DataFrame, weights: Weights, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    scored = docs.select("doc_id", "text").mapInArrow(functools.partial(_score, shared), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, weights: Weights, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns; the texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(functools.partial(_keep, shared, docs.columns.index("text"), threshold), docs.schema)
