"""SimHash near-duplicate groups by a segment-popcount embedding.

1. Fingerprint.  A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
   ``shingle`` words with repeats (a shorter text is one shingle, a text
   without words has fingerprint zero); a bit is set if it is set in over half
   of the shingles' XXH64 values (seed 42).
2. Embedding.  The 64 bits fall into 32 segments of two, and a fingerprint
   becomes the vector of its segments' bit counts.  The Manhattan distance of
   two vectors is never more than the Hamming distance of the fingerprints.
3. Grid range join.  Within ``radius`` 3 in all, one half of the 32
   dimensions is within distance 1, so the halves' vectors are cells of two
   unit grids, and a fingerprint visits its own cell and the cells one step up
   in one dimension; of two vectors one step apart, the lower visits the
   upper.  What meets in a cell is held to the Manhattan bound over all
   dimensions and then to the exact Hamming distance.
4. Groups.  A cell with many members yields a spanning forest of its links and
   not all pairs; the links of all cells are then contracted round by round to
   connected components.

Equal fingerprints are one node throughout, so a group of copies costs one row
from step 3 on.  Null and wordless texts share fingerprint zero and are linked
like any other; repeated rows are all returned; null ids are returned with the
group's smallest id and never are one; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import durable

SEED = 42
RADIUS = 3
#: A cell with more members is joined by itself, block by block, and yields a forest.
MANY = 32
#: A cell with more members is first cut by the bytes of the fingerprints' other half.
HUGE = 8192

_FIELDS = np.uint64(0x5555555555555555)
_LOW = np.uint64(0x3333333333333333)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    hashed = b"".join(xxhash.xxh64_digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    raw, total = np.frombuffer(hashed, np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for i in range(0, len(raw), 255):
        total += np.unpackbits(raw[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)  # at most 255
    return int.from_bytes(np.packbits(2 * total > len(raw)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, mark long, fp long): every row's fingerprint as a signed long, and a hash of its key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], [key, "mark", "fp"])

    out = df.select(key, F.xxhash64(key, text).alias("mark"), text)
    return out.mapInArrow(run, f"`{key}` {out.schema[key].dataType.simpleString()}, mark long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, two bits each."""
    return fp - (fp >> np.uint64(1) & _FIELDS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the popcount vectors of two arrays of fingerprints."""
    a, b = popcounts(a), popcounts(b)
    total = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for shift in (np.uint64(0), np.uint64(2)):
        # fields of four bits hold counts of 0..2; with 4 added none borrows from the next
        apart = (a >> shift & _LOW) + np.uint64(0x4444444444444444) - (b >> shift & _LOW)
        # 2..6 about 4: one bit of distance 1 (odd), two of distance 2 (2 or 6)
        odd = apart & np.uint64(0x1111111111111111)
        two = apart >> np.uint64(1) & ~apart & np.uint64(0x1111111111111111)
        total += np.bitwise_count(odd) + 2 * np.bitwise_count(two)
    return total


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index into fp, guest) of all visits; a guest comes from one step below."""
    counts, out = popcounts(fp), []
    every = np.arange(len(fp))
    for half in range(2):
        own = (counts >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64) | half << 32
        out.append((own, every, np.zeros(len(fp), bool)))
        for i in range(16):
            up = np.flatnonzero((own >> 2 * i & 3) < 2)
            out.append((own[up] + (1 << 2 * i), up, np.ones(len(up), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are within ``radius``: the lower bound first, exactly then."""
    found = manhattan(a, b) <= radius
    if found.any():
        found[found] = np.bitwise_count(np.broadcast_to(a, found.shape)[found] ^ np.broadcast_to(b, found.shape)[found]) <= radius
    return found


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were in different trees."""
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))
        return a != b


def cell_links(fp: np.ndarray, guest: np.ndarray, radius: int, half: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links within one large cell, as positions.

    Every member is compared with all; a hit links it to one of each tree that
    it meets, so a crowd costs as many links as it has members.
    """
    parts = [np.arange(len(fp))]
    if len(fp) > HUGE:
        # the other half agrees in at least one of its four bytes, as no more than 3 bits differ
        octets = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
        order = [(k, np.argsort(octets[:, k], kind="stable")) for k in (range(4, 8) if half == 0 else range(4))]
        parts = [part for k, by in order for part in np.split(by, np.flatnonzero(np.diff(octets[by, k])) + 1)]
    forest = Forest(len(fp))
    for part in parts:
        own, tree = fp[part], np.arange(len(part))
        for x in np.flatnonzero(~guest[part]).tolist():
            hit = np.flatnonzero(near(own, own[x], radius))
            others, first = np.unique(tree[hit], return_index=True)
            if len(others) > 1:
                for y in hit[first[others != tree[x]]].tolist():
                    forest.join(int(part[x]), int(part[y]))
                tree[np.isin(tree, others)] = tree[x]
    return forest.links


def _small(fp: np.ndarray, guest: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within small cells, given where each starts and how many it has."""
    each = np.repeat(starts + sizes, sizes) - 1
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = each - at
    left = np.repeat(at, after)
    right = left + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
    keep = ~(guest[left] & guest[right]) & (fp[left] != fp[right])
    left, right = left[keep], right[keep]
    keep = near(fp[left], fp[right], radius)
    return left[keep], right[keep]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a long, b long), a < b: links between the different fingerprints in ``nodes.fp`` that connect all within ``radius`` of each other."""
    if not 0 <= radius <= 3:
        raise ValueError("one half within distance 1 is sure only up to a radius of 3")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            cell, index, guest = cells(fp.view(np.uint64))
            for i in range(0, len(cell), 1 << 18):
                part = slice(i, i + (1 << 18))
                yield pa.record_batch([pa.array(cell[part]), pa.array(fp[index[part]]), pa.array(guest[part])], ["cell", "fp", "guest"])

    def meet(cell: np.ndarray, fp: np.ndarray, guest: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole cells, in order of cell."""
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(cell)]]))
        pick = (sizes > 1) & (sizes <= MANY)
        pairs = [_small(fp, guest, starts[pick], sizes[pick], radius)] if pick.any() else []
        for start, size in zip(starts[sizes > MANY].tolist(), sizes[sizes > MANY].tolist(), strict=True):
            if found := cell_links(fp[start : start + size], guest[start : start + size], radius, int(cell[start] >> 32)):
                x, y = np.array(found).T + start
                pairs.append((x, y))
        for x, y in pairs:
            if len(x):
                a, b = fp[x].view(np.int64), fp[y].view(np.int64)
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            goes_on = held and held[-1][0][-1] == new[0][-1]
            held.append((new[0], new[1].view(np.uint64), new[2]))
            if goes_on:
                continue
            cell, fp, guest = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield from meet(cell[:whole], fp[:whole], guest[:whole])
            held = [(cell[whole:], fp[whole:], guest[whole:])]
        if held:
            yield from meet(*(np.concatenate(x) for x in zip(*held)))

    visits = nodes.select("fp").mapInArrow(visit, "cell long, fp long, guest boolean")
    dealt = visits.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the connected components of (a, b), root being a node's smallest reachable node.

    Each round maps every node to the smallest among itself and its
    neighbours, and then to that node's own; edges whose ends meet fall away.
    Rounds grow with the logarithm of the longest chain for hash-like ids.
    """
    edges = durable(edges.select("a", "b"))
    labels = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        step = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low"))
        lower = step.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        hop = durable(step.join(lower, "low").select("node", F.col("lowest").alias("root")))
        if labels is None:
            labels = hop
        else:
            on = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = durable(labels.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = hop.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = hop.select(F.col("node").alias("b"), F.col("root").alias("y"))
        both = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = durable(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _groups(marked: DataFrame, key: str, radius: int) -> DataFrame:
    """(fp, root, component_id): each fingerprint's component, named by its smallest fingerprint and by its smallest key."""
    nodes = durable(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(links(nodes, radius))
    linked = nodes.join(roots, nodes.fp == roots.node)
    first = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(first, "root").select("fp", "root", "component_id")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    # read from storage, so the join with the rows has plain exchanges on both sides and Spark can split a fingerprint that many rows share
    return durable(named)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): one row for each of ``df``; component_id is the smallest key reachable over links, the row's own included."""
    marked = durable(fingerprints(df, key, text, shingle))
    return marked.join(_groups(marked, key, radius), "fp").select(key, "fp", "component_id")
