"""Quality rules: a calibrated logistic regression over hashed n-grams, beside plain counts.

Word unigrams and bigrams and character trigrams (of code points) of a text are
hashed into buckets; a text's features are the shares of its n-grams that fall
into each bucket.  The weights are fitted on labelled rows by L-BFGS on the driver
and calibrated by Platt's sigmoid on labelled rows kept from the fit.  Both
see at most ``MAX_TRAIN`` rows a class, those with the smallest hash of their
id; everything is scored, in Arrow batches, against a fixed threshold.  A row
brings at most ``BUCKETS`` counts of six bytes to the driver, so all of them
take 150 MB at the very most, whatever the texts' lengths.

Defined cases: a null text has no words, so it fails the base rules; a text of
any length is read whole; without labelled rows of both classes the score is
1, so the base rules decide alone; without rows of both classes to calibrate on
the score is the uncalibrated sigmoid; an id with several texts teaches with
one of them, that of the least counts; repeated rows are judged alike; an empty
table gives no rows; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import id_crc, labelled

#: Buckets of the hashed features, a power of two.
BUCKETS = 1 << 13
#: Labelled rows a class that are fitted on, and a quarter as many that calibrate.
MAX_TRAIN = 1_200
#: Characters of a text whose n-grams are made at once.
SLICE = 1 << 20
#: A document is kept if its calibrated probability of label 1 is at least this.
THRESHOLD = 0.3
L2 = 1e-4
_SCALE = 30.0
_SHIFT = np.uint64(65 - BUCKETS.bit_length())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, size: int = 8) -> int:
    """Words inside windows of ``size`` words that occur twice or more.  Windows are numbered exactly, by pairing the numbers of two halves."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    window, span = ids, 1
    while span < size:
        window = np.unique(window[:-span] * (int(window.max()) + 1) + window[span:], return_inverse=True)[1]
        span *= 2
    again = np.bincount(window)[window] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - sum(map(len, words))
    chars = len(text or "") - spaces
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(_word_ids(words))


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    return ((codes + np.uint64(salt)) * _MIX >> _SHIFT).astype(np.int64)


def buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text: trigrams of code points, words, pairs of words; white space is one character."""
    data = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    code = np.where(space, np.uint32(32), data).astype(np.uint64)
    parts = [_mixed(code[:-2] | code[1:-1] << np.uint64(21) | code[2:] << np.uint64(42), 1)]
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if len(starts):
        # a word's code: its characters as a polynomial modulo 2**64
        inside = np.flatnonzero(~space)
        position = inside - np.repeat(starts, ends - starts)
        words = np.add.reduceat(code[inside] * _powers(int(position.max()) + 1)[position], np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        parts += [_mixed(words, 2), _mixed(words[:-1] * np.uint64(31) + words[1:], 3)]
    return np.concatenate(parts)


def bucket_parts(text: str) -> Iterator[np.ndarray]:
    """``buckets`` of a text in parts of about ``SLICE``, so that no text takes some 60 bytes a character."""
    if len(text) <= SLICE:
        yield buckets(text)
        return
    data = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (data == 32) | ((data >= 9) & (data <= 13))

    def codes(start: int, stop: int) -> np.ndarray:
        return np.where(space[start:stop], np.uint32(32), data[start:stop]).astype(np.uint64)

    for i in range(0, len(data) - 2, SLICE):
        code = codes(i, min(i + SLICE, len(data) - 2) + 2)
        yield _mixed(code[:-2] | code[1:-1] << np.uint64(21) | code[2:] << np.uint64(42), 1)
    edge = space[1:].view(np.int8) - space[:-1].view(np.int8)
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    del edge
    words = np.zeros(len(starts), np.uint64)
    for i in range(0, len(data), SLICE):
        # words from the slice's first character on, its last one may go on: a word's code is the sum of what its slices hold
        first, last = np.searchsorted(ends, i, "right"), np.searchsorted(starts, i + SLICE)
        if first == last:
            continue
        low, high = np.maximum(starts[first:last], i), np.minimum(ends[first:last], i + SLICE)
        inside = low[0] + np.flatnonzero(~space[low[0] : high[-1]])
        position = inside - np.repeat(low, high - low)
        # powers go on where the word's last slice ended
        ahead = np.array([pow(_BASE, int(n), 1 << 64) for n in low[:1] - starts[first : first + 1]] + [1] * (last - first - 1), np.uint64)
        part = codes(low[0], high[-1])[inside - low[0]] * _powers(int(position.max()) + 1)[position]
        words[first:last] += ahead * np.add.reduceat(part, np.concatenate([[0], np.cumsum(high - low)[:-1]]))
    for i in range(0, len(words), SLICE):
        yield _mixed(words[i : i + SLICE], 2)
        yield _mixed(words[i : i + SLICE][: len(words) - 1 - i] * np.uint64(31) + words[i + 1 : i + 1 + SLICE], 3)


_BASE = 0x100000001B3
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE, np.uint64)]))
    return _POWERS


@dataclass
class Model:
    """Weights by bucket, and the sigmoid that turns a raw score into a probability; no weights: always 1."""

    weights: np.ndarray | None
    slope: float = 1.0
    shift: float = 0.0

    def score(self, text: str) -> float:
        if self.weights is None:
            return 1.0
        total = n = 0
        for at in bucket_parts(text):
            total, n = total + self.weights[at].sum(), n + len(at)
        margin = _SCALE * float(total / n) if n else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def _minimise(loss, start: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search; ``loss`` returns value and gradient."""
    x, (value, slope) = start, loss(start)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        step, fall = 1.0, slope @ q
        if fall <= 1e-12:
            break
        while True:
            new = x - step * q
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * step * fall or step < 1e-8:
                break
            step /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    value = float(weight @ np.logaddexp(0, np.where(y > 0, -margin, margin)))
    return value, weight * (p - y)


def train(rows: list[tuple[np.ndarray, np.ndarray, float, bool]]) -> Model:
    """A model from (bucket, count, y, calibrates) of the labelled rows."""
    fitted, kept = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    if len({r[2] for r in fitted}) < 2:
        return Model(None)

    def matrix(part):
        at = np.concatenate([r[0] for r in part])
        share = np.concatenate([r[1] * (_SCALE / max(1, r[1].sum())) for r in part])
        row = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
        y = np.array([r[2] for r in part])
        return at, share, row, y, np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))

    at, share, row, y, weight = matrix(fitted)

    def loss(w):
        value, slope = _logistic(np.bincount(row, share * w[at], len(y)), y, weight)
        return value + L2 / 2 * float(w @ w), np.bincount(at, share * slope[row], BUCKETS) + L2 * w

    w = _minimise(loss, np.zeros(BUCKETS))
    if len({r[2] for r in kept}) < 2:
        return Model(w)
    at, share, row, y, weight = matrix(kept)
    margin = np.bincount(row, share * w[at], len(y))
    # Platt's targets keep the sigmoid from running off on separable rows
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def fit(ab):
        z = ab[0] * margin + ab[1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return float(weight @ (np.logaddexp(0, z) - target * z)), np.array([weight @ ((p - target) * margin), weight @ (p - target)])

    slope, shift = _minimise(fit, np.array([1.0, 0.0]))
    return Model(w, float(slope), float(shift)) if slope > 0 else Model(w)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """A model from the labelled documents: rows whose id's CRC-32 modulo 5 is 1 calibrate, 2 to 4 are fitted on, 0 are never seen."""
    fold = (id_crc(F.col("doc_id")) % 5).alias("fold")
    chosen = None
    rows = labelled(labels, label).select("doc_id", "y", fold, F.xxhash64("doc_id").alias("order"))
    for y in (0.0, 1.0):
        for part, n in ((F.col("fold") == 1, MAX_TRAIN // 4), (F.col("fold") > 1, MAX_TRAIN)):
            some = rows.where((F.col("y") == y) & part).orderBy("order", "doc_id").limit(n)
            chosen = some if chosen is None else chosen.union(some)
    # at most 2.5 * MAX_TRAIN rows of three numbers
    texts = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", (F.col("fold") == 1).alias("calibrates"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for x in batch.column(1):
                each = sum(np.bincount(part, minlength=BUCKETS) for part in bucket_parts(x.as_py()))
                at.append(np.flatnonzero(each).astype(np.int16))
                n.append(each[at[-1]].astype(np.int32))
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), _lists(at), _lists(n)], ["doc_id", "y", "calibrates", "at", "n"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    counted = sample.mapInArrow(count, f"doc_id {kind}, y double, calibrates boolean, at array<short>, n array<int>")
    # one text an id, should ids repeat
    found = counted.groupBy("doc_id").agg(F.min(F.struct("y", "calibrates", "at", "n")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    rows = [(a.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.float64), y.as_py(), c.as_py()) for y, c, a, n in zip(*(found.column(i) for i in range(1, 5)), strict=True)]
    return train(rows)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def verdict(text: str | None, model: Model, threshold: float) -> tuple:
    """The five counts, base_failed, score and kept of one text."""
    counts = base_counts(text)
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    score = model.score(text or "")
    return (*counts, failed, score, not failed and score >= threshold)


def judge(documents: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, base_failed, score, kept) for every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [key, *(x.split()[0] for x in _OUT.split(", "))]
        for batch in batches:
            rows = [verdict(x.as_py(), model, threshold) for x in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    out = documents.select(key, text)
    return out.mapInArrow(run, f"`{key}` {out.schema[key].dataType.simpleString()}, {_OUT}")


def keep(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``judge`` would keep; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([verdict(x.as_py(), shared.value, threshold)[-1] for x in batch.column(place)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
