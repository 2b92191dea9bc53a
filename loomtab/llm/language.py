"""Language identification by rank-order profiles of n-grams.

A text's letters, lower-cased, form words with a boundary mark on either side;
its n-grams of one to three marks and letters are ranked by count (ties by
n-gram), and the first ``TOP`` make its profile.  A language's profile is that
of all its training texts together.  The out-of-place distance of a text to a
language adds up, over the text's profile, how far each n-gram's ranks lie
apart, ``TOP`` where the language lacks it; the nearest language wins, ties
going to the first name.  (Cavnar and Trenkle, 1994.)

Counts cover every training text: a task counts its own n-grams a language and
Spark adds the counts up, so a language that holds most rows is no hot key.

Defined cases: a null text and one without letters are ``und`` with score 0,
as is everything if nothing was learned; texts are read whole; rows with a null
lang or text teach nothing, repeated ones teach as often as they occur; further
columns are left aside.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtab.llm.common import id_crc

#: Ranks in a profile.
TOP = 400
UNKNOWN = "und"
#: Parts of a language's n-grams that are ranked by themselves first.
SPREAD = 16
#: Distinct n-grams that a task counts before it hands its counts on.
HELD = 400_000

_BITS = np.uint64(21)  # of a code point


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter; 0 for what is no letter or lower-cases to more than one character."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, 0 being the boundary mark; empty without letters."""
    if not text:
        return np.zeros(0, np.uint64)
    if not _TABLE:
        _TABLE.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.concatenate([[0], _TABLE[0][points], [0]]).astype(np.uint64)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    letters = letters[keep]
    if len(letters) < 3:
        return np.zeros(0, np.uint64)
    one = letters[letters != 0]
    two = letters[:-1] << _BITS | letters[1:]
    three = letters[:-2] << _BITS << _BITS | two[1:]
    three = three[letters[1:-1] != 0]  # none across two words
    # the length goes on top, so a short n-gram is no prefix of a longer one
    return np.concatenate([one, two + (np.uint64(1) << np.uint64(42)), three | np.uint64(1) << np.uint64(63)])


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.diff(np.concatenate([starts, [len(codes)]]))


def profile(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent codes in order of rank."""
    if len(codes) > 2 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:top]


def learn(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles by language from all rows of ``documents`` that have a lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            codes, counts = (np.concatenate(x) for x in zip(*parts))
            codes, at = np.unique(codes, return_inverse=True)
            return codes, np.bincount(at, counts).astype(np.int64)

        def flush():
            for name, parts in held.items():
                codes, counts = merged(parts)
                yield pa.record_batch([pa.array([name] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.setdefault(name, []).append(grams(x.as_py()))
                if (size := size + len(texts[name][-1])) > 4_000_000:
                    for k, parts in texts.items():
                        held.setdefault(k, []).append(tally(np.concatenate(parts)))
                    texts, size = {}, 0
            for k, parts in texts.items():
                held.setdefault(k, []).append(tally(np.concatenate(parts)))
            size = 0
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                for k in held:
                    held[k] = [merged(held[k])]
                if sum(len(parts[0][0]) for parts in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the largest counts of each sixteenth of a language's n-grams, and the largest of those here
    order = Window.partitionBy("lang", F.pmod("code", F.lit(SPREAD))).orderBy(F.desc("n"), "code")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank").toPandas()  # SPREAD * top rows a language at most
    return {str(name): profile(rows["code"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), top) for name, rows in best.groupby("lang", sort=True)}


class Judge:
    """Distances of a text's profile to those of all languages."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.top, self.names = top, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer it is than the next, or than nothing."""
        codes = grams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = profile(*tally(codes), self.top)
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.top).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (self.top * len(own)))


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(key, lang_pred, score) for every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, top)
        for batch in batches:
            found = [judge(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [key, "lang_pred", "score"])

    out = documents.select(key, text)
    return out.mapInArrow(run, f"`{key}` {out.schema[key].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id, modulus: int = 4, rest: int = 2):
    """Whether a row's id keeps it from training."""
    return F.coalesce(id_crc(doc_id) % modulus == rest, F.lit(False))
