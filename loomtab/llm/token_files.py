"""Token-id files in Simple-8b coding.

Ids are packed into 64-bit words: the top four bits of a word select how many
ids of what width fill the other sixty, the most that fit (Anh and Moffat,
2010); an id wider than sixty bits is escaped into a word of its own after a
word with the escape selector.  A block holds up to ``BLOCK_IDS`` ids of whole
documents (one longer document makes a block by itself) as little-endian words,
with the documents' offsets in it, so a reader unpacks any block by itself,
all words of one selector at once.

Files are Parquet written and committed by Spark, a row a block, in ascending
order of document id over files and within them: the writer range-partitions by
id, and the partition's number stands in each block.

Ids are those that the tokenizers library gives a whole text without adding
special tokens; the literal of a special token in a text is that token unless
``special_as_text``, as the library has it.

Defined cases: a null text counts as empty and still gets its end id; texts are
encoded whole; rows of equal id stand side by side in order of their texts'
hash, null ids first; an empty table gives files without blocks; further
columns are left aside.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtab.llm.common import durable, sized
from loomtab.llm.rows import STOPS, Rows

#: Ids in a block, about.
BLOCK_IDS = 1 << 16
#: Bytes that a task's remembered words take at most, about.
MEMORY = 64 << 20
#: Characters of text that are encoded together, texts kept whole.
TOGETHER = 1_000_000
#: Selector s packs COUNTS[s] ids of 60 // COUNTS[s] bits; the last is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15

# A normaliser and a pre-tokenizer that drop white space and never look across it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: ASCII marks that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(rf"(?m)^(?:([A-Za-zÀ-ÖØ-öø-ÿ]*)([{re.escape(MARKS)}]*)|.+)$")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 up in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


_WIDTH = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if not len(ids) or ids.max() < 1 << 16:
        return _WIDTH[ids.astype(np.uint16)]
    width = np.zeros(len(ids), np.uint8)
    for part in range(4):
        digit = (ids >> np.uint64(16 * part)).astype(np.uint16)  # the low bits of what is left
        width = np.where(digit > 0, _WIDTH[digit] + np.uint8(16 * part), width)
    return width


def pack(ids: np.ndarray) -> np.ndarray:
    """The 64-bit words of an array of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # the selector at each place, were a word to start there: the first whose ids all fit
    choice = np.full(n, ESCAPE, np.uint8)
    widest, span = _widths(ids), 1  # of the next ``span`` ids
    for s in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[s]
        if count > n:
            break
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[: n - span - step + 1], widest[step:])
            span += step
        choice[: n - count + 1][widest <= 60 // count] = s
    step = np.array([*COUNTS, 0, 1])[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        own, bits = np.flatnonzero(chosen == s), np.uint64(60 // COUNTS[s])
        for k in range(COUNTS[s]):
            words[own] |= ids[starts[own] + k] << np.uint64(k) * bits
    wide = chosen == ESCAPE
    return np.insert(words, np.flatnonzero(wide) + 1, ids[starts[wide]]) if wide.any() else words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids in an array of words, in order."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        # a word after an escape is a bare id, whatever its top bits
        bare = np.zeros(len(words), bool)
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if not bare[i]:
                bare[i + 1] = True
        escaped = words[bare]
        words, selector = words[~bare], selector[~bare]
    else:
        escaped = np.zeros(0, np.uint64)
    counts = np.array([*COUNTS, 0, 1])[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[starts[own]] = escaped
            continue
        bits = np.uint64(60 // COUNTS[s])
        mask = np.uint64((1 << int(bits)) - 1)
        for k in range(COUNTS[s]):
            out[starts[own] + k] = words[own] >> np.uint64(k) * bits & mask
    return out


class WordCodec:
    """Encodes with a tokenizers file, remembering words.

    Where the file's normaliser and pre-tokenizer are ``NORMALIZER`` and
    ``SPLIT``, which never look across white space, a text's ids are those of
    its words one after another; words are cut at spaces and line ends only.
    New words of Latin letters and a run of marks go to the library's model as
    the two pieces that its pre-tokenizer makes of them, other new words to the
    library whole.  With any other file texts go to the library as they are.
    """

    def __init__(self, raw: bytes, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        held = json.loads(raw)
        added = held.get("added_tokens") or []
        self.by_word = held.get("normalizer") == NORMALIZER and held.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
        self.by_word &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added)
        # a literal must hold "<", and must not be letters with marks after them
        self.by_word &= all("<" in t["content"] and not any(_PLAIN.findall(t["content"])[0]) for t in added)
        self.letters = _byte_letters()
        self.rows = Rows(np.uint32, MEMORY)

    def _put(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.rows.put(words, flat, np.cumsum(sizes) - sizes, sizes)

    def _model_ids(self, pieces: list[str]) -> list[list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        shown = (p if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in pieces)
        return [[t.id for t in tokenize(p)] for p in shown]

    def _learn(self, words: set[str]) -> None:
        known = self.rows.words
        if "" in words:
            self._put([""], [[]])
        words = [w for w in words if w]
        # letters and marks of every word, neither of one that isn't plain; words hold no line ends
        cut = _PLAIN.findall("\n".join(words)) if words else []
        whole = [w for w, found in zip(words, cut, strict=True) if not (found[0] or found[1])]
        for i in range(0, len(whole), 20_000):
            part = whole[i : i + 20_000]
            self._put(part, [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        parts = {w: [p for p in (found[0].lower(), found[1]) if p] for w, found in zip(words, cut, strict=True) if found[0] or found[1]}
        new = [p for p in set(chain.from_iterable(parts.values())) if p not in known]
        self._put(new, self._model_ids(new))
        self.rows.put_joined({w: found for w, found in parts.items() if w not in known})

    def _units(self, text: str) -> list[str]:
        """The words of a text; one of Latin letters alone is lower-cased first, so fewer differ."""
        if "<" not in text:
            try:
                text.encode("latin-1")
                text = STOPS.sub(r" \1", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin, and the end)."""
        if not self.by_word:
            ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        units: list[str] = []
        counts = [0]
        for text in texts:
            units += self._units(text) if text else ()
            counts.append(len(units))
        flat, before = self.rows.flat(units, self._learn)
        return flat, before[counts]


_CODECS: dict[tuple[bytes, bool], WordCodec] = {}


def _codec(raw: bytes, special_as_text: bool) -> WordCodec:
    """This worker's codec, without remembered words; its vocabulary outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    key = (raw, special_as_text)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(*key)
    return _CODECS[key]


def _together(column: pa.Array, size: int = TOGETHER) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) in runs of about ``size`` characters."""
    run, start, held = [], 0, 0
    for i, x in enumerate(column):
        run.append(x.as_py())
        held += len(run[-1] or "")
        if held >= size:
            yield start, run
            run, start, held = [], i + 1, 0
    if run:
        yield start, run


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", special_as_text: bool = False) -> None:
    """Encode every row, append ``end_id`` and write the files under ``path`` in ascending order of ``key``."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, special_as_text)
        block, docs, ids, lengths = 0, [], [], []

        def full():
            words = pack(np.concatenate(ids))
            sizes = np.concatenate(lengths).astype(np.int32)
            ends = pa.array([0, len(sizes)], pa.int32())
            held = [pa.ListArray.from_arrays(ends, pa.concat_arrays(docs)), pa.ListArray.from_arrays(ends, pa.array(sizes))]
            return pa.record_batch([pa.array([block], pa.int32()), *held, pa.array([words.astype("<u8").tobytes()], pa.binary())], ["block", "docs", "lengths", "words"])

        held = 0
        try:
            for batch in batches:
                for start, texts in _together(batch.column(1)):
                    flat, cuts = codec.encode_flat(texts)
                    flat, cuts = np.insert(flat, cuts[1:], end_id), cuts + np.arange(len(cuts))
                    at = 0
                    while at < len(texts):
                        # as many whole documents as the block has room for, one at least
                        room = int(np.searchsorted(cuts, cuts[at] + BLOCK_IDS - held, "right")) - 1
                        if room <= at:
                            if docs:
                                yield full()
                                block, docs, ids, lengths, held = block + 1, [], [], [], 0
                                continue
                            room = at + 1
                        docs.append(batch.column(0).slice(start + at, room - at))
                        ids.append(flat[cuts[at] : cuts[room]])
                        lengths.append(np.diff(cuts[at : room + 1]))
                        held += int(cuts[room] - cuts[at])
                        at = room
            if docs:
                yield full()
        finally:
            codec.rows.forget()

    order = [F.col(key), F.xxhash64(text)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents.select(key, text).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(run, f"block int, docs array<{kind}>, lengths array<int>, words binary")
    blocks.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids array<long>) for every document in the files: the ids, and the number of all ids before them."""
    return _read(spark, path, key, "ids array<long>", lambda ids, cuts: [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int64)))])


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) for every document in the files; the CRC is over the ids as little-endian 32-bit integers."""

    def digest(ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
        raw, at = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        return [pa.array(np.diff(cuts)), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])], pa.int64())]

    return _read(spark, path, key, "n_tokens long, ids_crc32 long", digest)


def _read(spark: SparkSession, path: str, key: str, columns: str, of) -> DataFrame:
    blocks = spark.read.parquet(path)
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    # ids before each block: sums over the parts, a row each, and within a part
    sizes = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = sizes.select("part", "block", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    starts = inside.join(sized(ahead), "part").select("part", "block", (F.col("ahead") + F.col("inside")).alias("before"))
    placed = blocks.join(sized(starts), ["part", "block"]).select("before", "docs", "lengths", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "start", *(c.split()[0] for c in columns.split(", "))]
        for batch in batches:
            for i in range(batch.num_rows):
                before, docs, lengths, words = (batch.column(k)[i] for k in range(4))
                cuts = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())]).astype(np.int64)
                ids = unpack(np.frombuffer(words.as_py(), "<u8"))
                yield pa.record_batch([docs.values, pa.array(cuts[:-1] + before.as_py()), *of(ids, cuts)], names)

    return placed.mapInArrow(run, f"`{key}` {kind}, start long, {columns}")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    durable(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
