"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Some twenty statistics of a document (lengths, shares of character classes,
repetition of words, pairs and lines, entropies) are standardised, bent, and mapped by
cosines with random frequencies, whose inner products approximate a Gaussian
kernel.  Every partition of the labelled rows sums its own normal equations;
their sum gives the ridge weights, and a second pass over labelled rows kept
from the fit gives the pairs for isotonic regression, which makes the raw
value a probability.

The statistics of all documents are worked out once and kept as small rows;
the fit uses those of at most ``MAX_TRAIN`` labelled rows, by hash of their id.

Defined cases: null and empty texts have zero words and are scored like any
other; texts are read whole; without rows of both labels every score is the
mean label, or 0.5 without labels; repeated rows score alike, a repeated id
counts as often as it occurs in the fit; a null id is never held out and never
fitted on; further columns are left aside.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import durable, id_crc, labelled, sized

#: Random features.
WIDTH = 192
#: Labelled rows that the fit and the calibration see at most, about.
MAX_TRAIN = 40_000
#: Partitions that sum normal equations of their own.
PARTS = 6
RIDGE = 1e-3
#: Standardised statistics are bent towards this bound, so one far out stays far out and doesn't turn the cosines many times.
BEND = 8.0
SEED = 20_24
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "log_bytes", "log_word_length", "log_word_spread", "upper", "digit", "space", "punctuation", "symbol", "pipe", "exclamation", "high_bytes",
    "unique_words", "top_word", "unique_pairs", "same_as_before", "lines_repeated", "line_length", "letters_entropy", "words_entropy", "symbol_words", "upper_words", "capital_words",
)

_BYTES = np.arange(256)
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(_BYTES, list(b"#*$%&<>@^~+=\\_/{}[]"))
_MARKS = np.isin(_BYTES, list(b".,;:!?'\"-()"))
_ENDS = tuple("#*$%&|<>!@^~=")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda mask: float(counts[mask].sum()) / n
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    often = np.fromiter(tally.values(), np.float64, len(tally)) / k if tally else np.ones(1)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / n
    return [
        math.log1p(len(words)), math.log1p(len(raw)), math.log1p(float(lengths.mean())), math.log1p(float(lengths.std())), share(_UPPER), share(_DIGIT), share(_SPACE), share(_MARKS), share(_SYMBOL),
        float(counts[124]) / k, float(counts[33]) / k, share(_BYTES >= 128), len(tally) / k, float(often.max()), pairs / max(1, len(words) - 1), same / k,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines))), float(-(p * np.log2(p)).sum()), float(-(often * np.log2(often)).sum()) / max(1.0, math.log2(k)),
        sum(w.endswith(_ENDS) for w in words) / k, sum(map(str.isupper, words)) / k, sum(map(str.istitle, words)) / k,
    ]


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<float>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py()) for x in batch.column(1)], np.float32).reshape(-1, len(STATISTICS))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], [key, "stats"])

    out = documents.select(key, text)
    return out.mapInArrow(run, f"`{key}` {out.schema[key].dataType.simpleString()}, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """Standardisation, frequencies and phases, ridge weights, and the calibration's corners."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    corners: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        scale = 1 / math.sqrt(len(STATISTICS))
        frequencies, phases = draw.normal(0, scale, (len(STATISTICS), WIDTH)), draw.uniform(0, 2 * math.pi, WIDTH)
        z = BEND * np.tanh((stats - self.mean) / (BEND * self.spread))
        return np.hstack([math.sqrt(2 / WIDTH) * np.cos(z @ frequencies + phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.corners, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners and values of the increasing step function nearest to y, by pooling adjacent violators; ties in x are pooled first."""
    x, at = np.unique(x, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for left, w, t in zip(x, weight, total, strict=True):
        blocks.append([left, left, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, right, w2, t2 = blocks.pop()
            blocks[-1][1:] = [right, blocks[-1][2] + w2, blocks[-1][3] + t2]
    corners = np.array([c for b in blocks for c in ((b[0], b[1]) if b[0] < b[1] else (b[0],))])
    values = np.array([b[3] / b[2] for b in blocks for _ in ((0, 1) if b[0] < b[1] else (0,))])
    return corners, values


def training_rows(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, y, fold) of at most about ``MAX_TRAIN`` labelled rows whose id's CRC-32 modulo 5 isn't 0; those with 1 calibrate."""
    rows = labelled(labels, label).select("doc_id", "y", (id_crc(F.col("doc_id")) % 5).alias("fold")).where("fold > 0")
    n = rows.count()
    return rows if n <= MAX_TRAIN else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_TRAIN / n))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """A model from the labelled rows of ``documents``; only the bounded sample's texts are looked at."""
    rows = sized(training_rows(labels, label))
    sample = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(rows, "doc_id", "left_semi")
    return fit(measure(sample), rows)


def fit(measured: DataFrame, rows: DataFrame, key: str = "doc_id") -> Model:
    """A model from the statistics of the rows that ``training_rows`` chose."""
    rows = rows.withColumnRenamed("doc_id", key)
    train = durable(measured.join(rows, key).select("stats", "y", "fold").repartition(PARTS))
    p = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * p + 3)
        for batch in batches:
            s, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            total += np.concatenate([s.sum(0), (s * s).sum(0), [len(s), y.sum(), 0]])
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    def summed(run) -> np.ndarray:
        parts = train.mapInArrow(run, "sums array<double>").toArrow().column("sums")  # one row a partition
        return np.sum(parts.combine_chunks().flatten().to_numpy().reshape(len(parts), -1), axis=0)

    total = summed(moments)
    count, ones = total[2 * p], total[2 * p + 1]
    mean = total[:p] / max(1, count)
    spread = np.sqrt(np.maximum(total[p : 2 * p] / max(1, count) - mean**2, 1e-8))
    model = Model(mean, spread, np.zeros(WIDTH + 1), np.zeros(1), np.array([ones / count if count else 0.5]))
    if not 0 < ones < count:
        return model
    balance = (count - ones, ones)  # each class weighs the same

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((WIDTH + 1, WIDTH + 2))
        for batch in batches:
            at = batch.column(2).to_numpy() > 1
            y = batch.column(1).to_numpy()[at]
            z = model.features(_matrix(batch.column(0))[at])
            weighted = z * np.where(y > 0, balance[0], balance[1])[:, None] / count
            a += weighted.T @ np.hstack([z, y[:, None]])
        yield pa.record_batch([pa.array([a.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    a = summed(normal).reshape(WIDTH + 1, WIDTH + 2)
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * np.eye(WIDTH + 1), a[:, -1])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() == 1
            raw = model.raw(_matrix(batch.column(0))[at])
            yield pa.record_batch([pa.array(raw), pa.array(batch.column(1).to_numpy()[at])], ["x", "y"])

    found = train.mapInArrow(pairs, "x double, y double").toArrow()  # a quarter of the bounded sample
    x, y = found.column("x").to_numpy(), found.column("y").to_numpy()
    if not 0 < y.sum() < len(y):
        model.corners, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    # a smoothed end on either side: no finite sample proves a probability of 0 or 1
    model.corners, model.values = isotonic(x, y)
    model.values = (model.values * len(y) + 0.5) / (len(y) + 1)
    return model


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) for every row of ``documents``."""
    measured = durable(measure(documents, key, text))
    shared = documents.sparkSession.sparkContext.broadcast(fit(measured, training_rows(labels, label), key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return measured.mapInArrow(run, f"`{key}` {measured.schema[key].dataType.simpleString()}, score double, predicted int")


def keep(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score ``threshold`` or more; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(x.as_py()) for x in batch.column(place)], np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)
            yield batch.filter(pa.array(shared.value.score(stats) >= threshold))

    return documents.mapInArrow(run, documents.schema)
