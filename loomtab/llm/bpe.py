"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut into pieces by the tokenizer's pattern and each piece is merged
by itself: the leaves of a segment tree stand for byte positions and hold the
rank of the pair that starts there, every inner node the smallest rank below
it and, among equal ranks, the leftmost position.  The root names the next
merge; a merge changes three leaves (the merged token's, its left neighbour's
and the swallowed one's), so a piece of n bytes takes O(n log n) however long
it is.

Words that came before in a task are looked up: their ids lie in one array, and
a run of texts is one gather from it.  What a task remembers is bounded in
bytes, holds no long words and goes when the task ends.

Ids equal those of the tiktoken library without special tokens.  A null text
counts as empty: no ids, no bytes; null ids decode to no bytes.  An empty table
gives no rows; texts are read whole, words of any length too.  Repeated rows
are encoded like any others and further columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomtab.llm.rows import STOPS, Rows, gather

#: Bytes that a task's remembered words and pieces take at most, about; when full, they are forgotten.
MEMORY = 64 << 20
#: Characters of text that are encoded together, texts kept whole.
TOGETHER = 1_000_000
#: Pieces of more bytes have a segment tree of their own.
LONG = 64
#: Pieces that are merged in step.
BLOCK = 2048

_POS = 32
_MASK = (1 << _POS) - 1
_NONE = 1 << 62
_LAST = np.int32(2**31 - 1)
_SPACES = [c for c in map(chr, range(0x3001)) if regex.match(r"\s", c)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Ranks of adjacent token pairs for whole arrays, in an open-addressed table; -1 where a pair doesn't merge."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, value = self._slot(keys), np.fromiter(pairs.values(), np.int32, len(pairs))
        while keys.size:
            free = self.keys[slot] == -1
            _, one = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[one]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], value[placed]
            left = np.ones(keys.size, bool)
            left[placed] = False
            keys, value, slot = keys[left], value[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found, held = self.values[slot], self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        found[held == -1] = -1
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            found[open_] = np.where(same, self.values[slot[open_]], -1)
            open_ = open_[~same & (held != -1)]
        return found


class Strings:
    """Byte strings by number, gathered many at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return gather(self.pool, self.starts[ids], self.lengths[ids]).tobytes()

    def cuts(self, ids: np.ndarray, cuts: np.ndarray) -> list[int]:
        """Where each part of ``ids`` begins in ``joined``, and its end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])[cuts].tolist()


class ByteBpe:
    """A codec for one vocabulary.  ``ranks``: token bytes to id; ``pattern``: cuts a text into pieces.

    White space that stands between two other characters must always start a
    piece, as it does with patterns of this family; ``TRIAL`` is cut to see
    that it does, and letters after a space are one piece; otherwise texts are
    cut by the pattern as wholes.
    """

    TRIAL = "a b. c1, 2 d,\ne!! éà\nx (y) 's ##\nZ don't \u4e2d 5"

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = Strings(tokens)
        self.digits = Strings([b",%d" % rank for rank in range(len(tokens))])
        self.pairs = PairTable(ranks)
        self.cut = regex.compile(pattern).findall
        self.by_word = pattern != "" and self.cut(self.TRIAL) == [p for u in self._split(self.TRIAL) for p in self._pieces(u)]
        self.rows = Rows(np.uint16 if len(tokens) <= 1 << 16 else np.uint32, MEMORY)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        size = 1 << max(n - 2, 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << _POS | i
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            tree[node] = value
            while node > 1:
                beside = tree[node ^ 1]
                if beside < value:
                    value = beside
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while (least := tree[1]) != _NONE:
            at = least & _MASK
            gone = end[at]
            stop = end[at] = end[gone]
            put(gone, _NONE) if gone < n - 1 else None
            rank = None
            if stop < n:
                before[stop] = at
                rank = ranks.get(piece[at : end[stop]])
            put(at, _NONE if rank is None else rank << _POS | at)
            if (left := before[at]) >= 0:
                rank = ranks.get(piece[left:stop])
                put(left, _NONE if rank is None else rank << _POS | left)
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at : end[at]]])
            at = end[at]
        return tuple(ids)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many pieces: (ids, where each piece's begin, how many it has).  Pieces of like length share one array of segment trees and are merged in step, one merge each at a time; long ones go by themselves."""
        sizes, starts = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = []
        used = 0
        by_size: dict[int, list[int]] = {}
        whole: list[int] = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                starts[k] = len(whole)
                whole.append(rank)
            elif len(piece) <= LONG:
                by_size.setdefault(1 << max(len(piece) - 2, 1).bit_length(), []).append(k)
            else:
                by_size.setdefault(0, []).append(k)
        parts, used = [np.array(whole, np.int64)], len(whole)
        for size, members in by_size.items():
            members.sort(key=lambda k: len(pieces[k]))  # pieces of one length end together
            for i in range(0, len(members), BLOCK):
                block = members[i : i + BLOCK]
                if size:
                    flat, each = self._in_step([pieces[k] for k in block], size)
                else:
                    each_ids = [self.merge(pieces[k]) for k in block]
                    flat, each = np.concatenate([np.array(x) for x in each_ids]), np.array([len(x) for x in each_ids])
                sizes[block], starts[block] = each, used + np.cumsum(each) - each
                parts.append(flat)
                used += len(flat)
        return np.concatenate(parts), starts, sizes

    def _in_step(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        count, width = len(pieces), size + 1
        lengths = np.fromiter(map(len, pieces), np.int32, count)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        token = self.pairs.of_byte[raw]
        leaf = np.arange(size, dtype=np.int32)
        # a node: rank and place in one number
        tree = np.full((count, 2 * size), _LAST, np.int32)
        first = self.pairs.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(count, size)
        tree[:, size:] = np.where((first >= 0) & (leaf < lengths[:, None] - 1), first << 7 | leaf, _LAST)
        level = size
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half
        end = np.tile(np.arange(1, width + 1, dtype=np.int32), (count, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (count, 1))
        starts = np.arange(width) < lengths[:, None]
        tree, token, end, before, starts = (x.reshape(-1) for x in (tree, token, end, before, starts))

        def put(root: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node, level = at + size, size
            tree[root + node] = value
            while level > 1:
                value = np.minimum(value, tree[root + (node ^ 1)])
                node = node >> 1
                tree[root + node] = value
                level >>= 1

        rows = np.arange(count)
        while True:
            least = tree[rows * (2 * size) + 1]
            going = least != _LAST
            rows, least = rows[going], least[going]
            if not rows.size:
                break
            root, base, length = rows * (2 * size), rows * width, lengths[rows]
            at, merged = least & 127, least >> 7
            here = base + at
            gone = end[here]
            stop = end[base + gone]
            end[here] = stop
            token[here] = merged
            starts[base + gone] = False
            pair = np.flatnonzero(gone < length - 1)
            put(root[pair], gone[pair], np.full(pair.size, _LAST))
            more = np.flatnonzero(stop < length)
            after = base[more] + stop[more]
            before[after] = at[more]
            value = np.full(rows.size, _LAST)
            rank = self.pairs.rank(merged[more], token[after])
            value[more] = np.where(rank >= 0, rank << 7 | at[more], _LAST)
            put(root, at, value)
            left = before[here]
            has = np.flatnonzero(left >= 0)
            left = left[has]
            rank = self.pairs.rank(token[base[has] + left], merged[has])
            put(root[has], left, np.where(rank >= 0, rank << 7 | left, _LAST))
        starts = starts.reshape(count, width)
        return token.reshape(count, width)[starts], starts.sum(1)

    def _split(self, text: str) -> list[str]:
        """A text cut before its single spaces, line ends and the marks that end a word, for one without other white space beside them and without NUL."""
        return STOPS.sub("\0\\1", text).replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def _pieces(self, unit: str) -> list[str]:
        return [unit] if unit[:1] == " " and unit[1:].isalpha() else self.cut(unit)

    def units(self, text: str) -> list[str]:
        """A text in parts that can be encoded by themselves: words with the space or line end before them, or else pieces."""
        plain = self.by_word and not (text[:1].isspace() or text[-1:].isspace() or "\0" in text)
        if plain and not any(c in text and (f"{c} " in text or f" {c}" in text or f"{c}\n" in text or f"\n{c}" in text) for c in _SPACES):
            return self._split(text)
        return self.cut(text)

    def _learn(self, words: set[str]) -> None:
        """Remember words and the pieces that they consist of."""
        cut = {w: self._pieces(w) for w in words}
        new = list({p for found in cut.values() for p in found}.difference(self.rows.words))
        self.rows.put(new, *self.merge_many([p.encode("utf-8", "surrogatepass") for p in new]))
        self.rows.put_joined({w: found for w, found in cut.items() if len(found) > 1})

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin, and the end)."""
        units: list[str] = []
        counts = [0]  # units up to each text's end
        for text in texts:
            units += self.units(text) if text else ()
            counts.append(len(units))
        flat, before = self.rows.flat(units, self._learn)
        return flat, before[counts]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts."""
        flat, cuts = self.encode_flat(texts)
        return [flat[i:j].tolist() for i, j in zip(cuts, cuts[1:])]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one whole text."""
        return self.encode_many([text])[0]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return self.tokens.joined(np.asarray(ids, np.int64))


def together(column: pa.Array) -> Iterator[list[str | None]]:
    """The values of a text column in runs of about ``TOGETHER`` characters."""
    run, size = [], 0
    for x in column:
        text = x.as_py()
        run.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


_CODECS: dict[tuple, ByteBpe] = {}


def _codec(shared, pattern: str) -> ByteBpe:
    """This worker's codec, without remembered words; its vocabulary outlives a task."""
    key = (shared.value[0], pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBpe(shared.value[1], pattern)
    return _CODECS[key]


def _shared(df: DataFrame, path: str):
    ranks = read_ranks(path)
    mark = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((mark, ranks))


def _mapped(df: DataFrame, path: str, pattern: str, key: str, column: str, made: str, of) -> DataFrame:
    """(key, made columns) by ``of`` (codec, column of a batch), which gives the columns of a run of rows."""
    shared = _shared(df, path)
    names = [key, *(c.split()[0] for c in made.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        try:
            for batch in batches:
                at = 0
                for n, columns in of(codec, batch.column(1)):
                    yield pa.record_batch([batch.column(0).slice(at, n), *columns], names)
                    at += n
        finally:
            codec.rows.forget()

    out = df.select(key, column)
    return out.mapInArrow(run, f"`{key}` {out.schema[key].dataType.simpleString()}, {made}")


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row of ``df``."""

    def of(codec: ByteBpe, column: pa.Array):
        for texts in together(column):
            flat, cuts = codec.encode_flat(texts)
            yield len(texts), [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32)))]

    return _mapped(df, path, pattern, key, text, "ids array<int>", of)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary): the bytes that each row's ids stand for; null ids give empty bytes."""

    def of(codec: ByteBpe, column: pa.Array):
        yield len(column), [pa.array([codec.decode(x or []) for x in column.to_pylist()], pa.binary())]

    return _mapped(df, path, "", key, ids, "bytes binary", of)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded again, and both digested, in one pass."""

    def of(codec: ByteBpe, column: pa.Array):
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for texts in together(column):
            ids, cuts = codec.encode_flat(texts)
            written, back = memoryview(codec.digits.joined(ids)), memoryview(codec.tokens.joined(ids))
            at, then = codec.digits.cuts(ids, cuts), codec.tokens.cuts(ids, cuts)
            marks = [sha(written[i + 1 : j]) for i, j in zip(at, at[1:])]  # without the first comma
            backs = [sha(back[i:j]) for i, j in zip(then, then[1:])]
            yield len(texts), [pa.array(np.diff(cuts)), pa.array(marks, pa.string()), pa.array(backs, pa.string())]

    return _mapped(df, path, pattern, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", of)
