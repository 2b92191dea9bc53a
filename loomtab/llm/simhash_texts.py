"""SimHash near-dedup of whole texts: five-word shingles and a similarity of 0.8 or more.

``simhash`` links fingerprints of 64 bits within 3, for which two half-grids
are exact.  Texts whose shingle sets overlap by 0.8 differ in some 15 % of the
bits, too many for that, so here

1. a text has a fingerprint of ``LANES`` times 64 bits, of the set of its
   hashed shingles (a text of fewer words is one shingle);
2. it is embedded as the bit counts of its two-bit segments, and each of
   ``TABLES`` grids takes the counts of ``PICK`` segments as a cell: texts at
   similarity 0.8 share a given cell with chance 0.044 and miss all 64 with
   6 %, at 0.85 with 1 %, at 0.9 with less than one in a thousand;
3. what meets in a cell is held to the Manhattan distance of the counts, a
   lower bound, and then to the Hamming distance, at most ``RADIUS`` (at 0.8
   distances are 39 with deviation 6).  Beside its fingerprint a text has its
   set's size and, in ``ODD`` buckets, whether a bucket holds an odd number of
   its hashes: sets differ in as many hashes as in such bits at least, so a
   pair whose sizes or bits differ by too much for the similarity is surely
   below it and no candidate;
4. a cell gives the minimum spanning forest of its links by distance, in all
   but the first grids also each member's ``NEAREST`` next to it, never all
   pairs; each link is verified exactly, by the share of shingles that the two
   sets have in common;
5. verified links are contracted to components.  The first ``FIRST`` grids go
   ahead, every text's nearest link before its others; then the rest of the
   grids give links between different components only, so a large group costs
   them no rows;
6. what forests and parts of cells passed over is made good exactly: texts of
   several groups that are connected by candidates, verified or not, or that
   share a cell which was compared in parts, are a crowd, and in each crowd
   all pairs of different groups are compared by their shingle sets, large
   crowds in blocks.  So every pair of the similarity that shares a cell and
   is within the radius is linked, whatever the cells' sizes; the price is
   the square of a crowd's texts in time.

The cells are dealt by ranges of (cell, further counts), so a group of near
copies that holds a third of all rows is spread over many tasks, and a task
compares at most ``HUGE`` members of a cell at a time, those of like further
counts together; a cell that lies across two ranges is compared in two parts.
Whether a pair shares a cell within the radius is a matter of chance by design,
measured in the tests; precision is exact.

Equal fingerprints are one node, so copies cost one row from step 2 on.  Null
and wordless texts are alike.  Null ids and repeated rows are rows like any
other; texts are read whole; an empty table gives no rows; further columns are
kept, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import durable, read_lightly, sized
from loomtab.llm.simhash import Forest, components, manhattan

SHINGLE, SIMILARITY = 5, 0.8
LANES = 4
TABLES, PICK = 64, 10
FIRST = 8
RADIUS = 56
#: Buckets of the parities that bound how many shingles two sets differ in.
ODD = 128
#: Links that a member of a cell may add to the forest's.
NEAREST = 4
#: Members of a cell that are compared pair by pair; more are joined by Prim's algorithm.
MANY = 64
#: Members of a cell that are compared at once.
HUGE = 4096
#: Texts, and hashes of their sets, in a block of a crowd that is compared in full.
BLOCK, BLOCK_HASHES = 1024, 1 << 21
#: Blocks of smaller crowds, so that many tasks share their pairs.
SPREAD = 24
#: Edges that one task puts into components, 16 bytes each.
FEW = 200_000
#: Buckets of the parities there.
WIDE = 1024
SEED = 9

_PRIME = np.uint64(0x100000001B3)
_LANE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_POWERS = np.ones(1, np.uint64)


def _word_codes(raw: bytes) -> np.ndarray:
    """A number for every word: its bytes as a polynomial modulo 2**64."""
    global _POWERS
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    if len(_POWERS) < longest:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * longest, _PRIME)]))
    inside = np.flatnonzero(~space)
    place = inside - np.repeat(starts, ends - starts)
    return np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, A-Z lower-cased."""
    codes = _mixed(_word_codes((text or "").encode("utf-8", "surrogatepass").lower()))
    n = min(shingle, len(codes))
    if not n:
        return codes
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = _mixed(out * _PRIME + codes[k : len(codes) - n + 1 + k])
    return np.unique(out)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``LANES`` words of the SimHash of a set of hashes; zeros for none."""
    total = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(hashes), 255):
        part = hashes[i : i + 255, None] + _LANE * np.arange(1, LANES + 1, dtype=np.uint64)
        bits = np.unpackbits(_mixed(part).view(np.uint8).reshape(len(part), -1), axis=1)
        total += bits.sum(axis=0, dtype=np.uint8)  # at most 255
    return np.packbits(2 * total > len(hashes)).view(np.uint64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each bucket of hashes whether it holds an odd number, as ``ODD`` bits."""
    return np.packbits(np.bincount((hashes % np.uint64(ODD)).astype(np.int64), minlength=ODD) % 2 == 1).view(np.uint64)


def _below(size: np.ndarray, odd: np.ndarray, left: np.ndarray, right: np.ndarray | int, similarity: float) -> np.ndarray:
    """Whether pairs of sets are surely below the similarity: too many hashes are in one of the two only."""
    apart = np.maximum(np.abs(size[left] - size[right]), _distance(odd[left], odd[right]))
    return (1 + similarity) * apart > (1 - similarity) * (size[left] + size[right]) + 1e-6


@functools.cache
def _picks() -> np.ndarray:
    """The segments of each grid, and of the further counts that order its cells."""
    draw = np.random.default_rng(SEED)
    return np.array([draw.permutation(32 * LANES)[: 2 * PICK] for _ in range(TABLES)])


def cells(prints: np.ndarray, start: int = 0, stop: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(cell, further) of every fingerprint in the grids from ``start`` to ``stop``, a column a grid."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    counts = (bits[:, ::2] + bits[:, 1::2]).astype(np.int32)
    powers = 3 ** np.arange(PICK, dtype=np.int32)
    picked = counts[:, _picks()[start:stop]]
    return picked[:, :, :PICK] @ powers + np.arange(start, stop) * 3**PICK, picked[:, :, PICK:] @ powers


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _near(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs within the radius, by the Manhattan bound first, and their distances."""
    bound = sum(manhattan(prints[left, k], prints[right, k]).astype(np.int32) for k in range(LANES))
    left, right = left[bound <= RADIUS], right[bound <= RADIUS]
    d = _distance(prints[left], prints[right])
    return left[d <= RADIUS], right[d <= RADIUS], d[d <= RADIUS]


def _prim(prints: np.ndarray, tree: np.ndarray, nearest: int, below: Callable) -> Iterator[tuple[int, int, int]]:
    """Minimum spanning forest of one large cell, and links to the nearest: (position, position, distance)."""
    n = len(prints)
    best, source = np.full(n, 1 << 20, np.int32), np.zeros(n, np.int64)
    at = 0
    left = np.arange(1, n)
    while len(left):
        apart = tree[left] != tree[at]
        d = _distance(prints[left], prints[at])
        d[below(left, at)] = 1 << 20
        d[~apart] = -1  # of one tree: joined, and no link
        if 0 < nearest < len(left):
            for k in np.argpartition(np.where(apart, d, 1 << 20), nearest)[:nearest].tolist():
                if 0 <= d[k] <= RADIUS:
                    yield at, int(left[k]), int(d[k])
        better = d < best[left]
        best[left[better]], source[left[better]] = d[better], at
        k = int(np.argmin(best[left]))
        at = int(left[k])
        left = np.delete(left, k)
        if 0 <= best[at] <= RADIUS:
            yield int(source[at]), at, int(best[at])


def forest(cell: np.ndarray, prints: np.ndarray, tree: np.ndarray, nearest: int = NEAREST, size: np.ndarray | None = None, odd: np.ndarray | None = None, similarity: float = 0.0) -> list[tuple[int, int, int]]:
    """(position, position, distance): minimum spanning forests of whole cells, which are in order, and links to the nearest; none within a ``tree``, nor, where ``size`` and ``odd`` are given, between sets that they show to be below the similarity."""

    def below(left: np.ndarray, right: np.ndarray | int, start: int = 0) -> np.ndarray:
        return np.zeros(len(left), bool) if size is None else _below(size, odd, start + left, start + right, similarity)

    starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    out = [(start + x, start + y, d) for start, n in zip(starts[sizes > MANY].tolist(), sizes[sizes > MANY].tolist(), strict=True) for x, y, d in _prim(prints[start : start + n], tree[start : start + n], nearest, functools.partial(below, start=start))]
    small = (sizes > 1) & (sizes <= MANY)
    starts, sizes = starts[small], sizes[small]
    if len(starts):
        after = np.repeat(starts + sizes, sizes) - 1
        at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        after -= at
        left = np.repeat(at, after)
        right = left + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
        apart = tree[left] != tree[right]
        left, right, d = _near(prints, left[apart], right[apart])
        maybe = ~below(left, right)
        left, right, d = left[maybe], right[maybe], d[maybe]
        if len(left):
            # what a tree has in a cell is one from the start
            own = np.unique(np.stack([cell, tree], axis=1), axis=0, return_inverse=True)[1].ravel()
            trees, had = Forest(int(own.max()) + 1), [0] * (int(own.max()) + 1)
            for k in np.argsort(d, kind="stable").tolist():
                x, y = int(own[left[k]]), int(own[right[k]])
                if trees.join(x, y) or had[x] < nearest or had[y] < nearest:
                    had[x], had[y] = had[x] + 1, had[y] + 1
                    out.append((int(left[k]), int(right[k]), int(d[k])))
    return out


_WORDS = [f"w{k}" for k in range(LANES)]
_PARITIES = [f"odd{k}" for k in range(ODD // 64)]
_LONGS = ["size", *_PARITIES, *_WORDS]
_SCHEMA = ", ".join(f"{c} long" for c in _LONGS)


def prints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, mark, size, odd0..., w0...): every row's set in brief and its fingerprint, and a hash of its key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(x.as_py(), shingle) for x in batch.column(2))
            found = np.array([np.concatenate([np.uint64([len(x)]), parities(x), fingerprint(x)]) for x in sets], np.uint64).reshape(-1, len(_LONGS)).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(_LONGS))]], ["key", "mark", *_LONGS])

    out = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    return out.mapInArrow(run, f"key {out.schema['key'].dataType.simpleString()}, mark long, {_SCHEMA}")


def links(nodes: DataFrame, start: int = 0, stop: int = TABLES, nearest: int = NEAREST, similarity: float = SIMILARITY) -> DataFrame:
    """(a long, b long, part long, d int): candidate links between nodes (node, tree, size, odd0..., w0...) of different trees in some of the grids, a < b, with the fingerprints' distance and no part.

    A cell that is compared in parts, or may be, gives its members (b) beside its number (a) and that of the part, without a distance.
    """
    columns = ["cell", "further", "node", "tree", *_LONGS]
    own = len(_LONGS) - LANES  # longs before the fingerprint's

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                words = np.stack([part.column(2 + own + k).to_numpy(zero_copy_only=False) for k in range(LANES)], axis=1)
                cell, further = cells(np.ascontiguousarray(words).view(np.uint64), start, stop)
                again = np.repeat(np.arange(part.num_rows), stop - start)
                taken = [part.column(k).take(pa.array(again)) for k in range(2 + len(_LONGS))]
                yield pa.record_batch([pa.array(cell.ravel().astype(np.int64)), pa.array(further.ravel().astype(np.int32)), *taken], columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 32, 0

        def told(cell: int, node: np.ndarray) -> pa.RecordBatch:
            n = len(node)
            return pa.record_batch([pa.array(np.full(n, cell)), pa.array(node), pa.nulls(n, pa.int32()), pa.array(np.full(n, task + done, np.int64))], names)

        def found(cell, node, tree, longs):
            pairs = forest(cell, np.ascontiguousarray(longs[:, own:]).view(np.uint64), tree, nearest, longs[:, 0], np.ascontiguousarray(longs[:, 1:own]).view(np.uint64), similarity)
            if pairs:
                x, y, d = np.array(pairs).T
                # a forest's link may be one to the nearest as well, and two cells may give the same
                ends, first = np.unique(np.sort(np.stack([node[x], node[y]]), axis=0), axis=1, return_index=True)
                yield pa.record_batch([pa.array(ends[0]), pa.array(ends[1]), pa.array(d[first].astype(np.int32)), pa.nulls(len(first), pa.int64())], names)

        names = ["a", "b", "d", "part"]
        held = opening = cut = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3)] + [np.stack([batch.column(4 + k).to_numpy(zero_copy_only=False) for k in range(len(_LONGS))], axis=1)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cell = held[0]
            last = whole = int(np.searchsorted(cell, cell[-1]))
            opening = int(cell[0]) if opening is None else opening
            while len(cell) - whole >= HUGE:  # the last cell goes in parts
                yield told(int(cell[-1]), held[1][whole : whole + HUGE])
                whole, done = whole + HUGE, done + 1
            if whole:
                # the range's first cell may have begun in another task, or have parts that are done
                if n := int(np.searchsorted(cell[:last], cell[0], "right")) * (int(cell[0]) in (opening, cut)):
                    yield told(int(cell[0]), held[1][:n])
                cut = int(cell[-1]) if whole > last else cut
                # a part of a large cell that is done is a cell of its own
                parts = cell[:whole].copy()
                parts[last:] = -1 - np.arange(whole - last) // HUGE
                yield from found(parts, *[x[:whole] for x in held[1:]])
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            # and the last may go on in another
            for c in {int(held[0][0]), int(held[0][-1])} & {opening, cut, int(held[0][-1])}:
                yield told(c, held[1][held[0] == c])
            yield from found(*held)

    spark = nodes.sparkSession
    visits = nodes.select("node", "tree", *_LONGS).mapInArrow(visit, f"cell long, further int, node long, tree long, {_SCHEMA}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = visits.repartitionByRange(parts, "cell", "further").sortWithinPartitions("cell", "further")
    return dealt.mapInArrow(meet, "a long, b long, d int, part long").groupBy("a", "b", "part").agg(F.min("d").alias("d"))


def grouped(edges: DataFrame) -> DataFrame:
    """``components``, in one task if the edges have been counted and are few: each round of jobs costs the driver memory."""
    edges = durable(edges.select("a", "b"))
    if edges.limit(FEW + 1).count() > FEW:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)]) for b in batches]
        # in order of the nodes, so the smallest place is the smallest node's
        node, place = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
        forest = Forest(len(node))
        for x, y in place.reshape(2, -1).T.tolist():
            forest.join(x, y)
        root = np.array([forest.find(x) for x in range(len(node))], np.int64)
        yield pa.record_batch([pa.array(node), pa.array(node[root])], ["node", "root"])

    return durable(edges.coalesce(1).mapInArrow(run, "node long, root long"))


def sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, held): the shingle set of every row of (node, text); nothing is sorted or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["node", "held"])

    return texts.select("node", "text").mapInArrow(run, "node long, held array<long>")


def joined(held: list[np.ndarray], tree: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different trees and, where not all are of one, different sides, such that all within the similarity are connected, as positions: every pair is compared."""
    size, tree, out = np.array([len(x) for x in held], np.int64), np.unique(tree, return_inverse=True)[1], []
    odd = np.array([np.packbits(np.bincount((x % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) % 2 == 1).view(np.uint64) for x in held])
    across = side.min() != side.max()
    for i in range(len(held) - 1):
        others = i + 1 + np.flatnonzero((tree[i + 1 :] != tree[i]) & ((side[i + 1 :] != side[i]) | (not across)))
        for j in others[~_below(size, odd, others, i, similarity)].tolist():
            if tree[i] != tree[j]:
                shared = len(np.intersect1d(held[i], held[j], assume_unique=True))
                if shared >= similarity * (len(held[i]) + len(held[j]) - shared):
                    tree[tree == tree[j]] = tree[i]
                    out.append((i, j))
    return out


def rest(crowds: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame | None:
    """(a, b): links between roots that connect all nodes within the similarity that share a crowd (crowd, node, root, size, few), exactly; None if no crowd has ``few`` texts or more and several roots.

    A large crowd is dealt in blocks, and each two of them meet in a task.
    """
    open_ = crowds.groupBy("crowd").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("root").alias("x"), F.max("root").alias("y"), F.min("few").alias("few")).where("n >= few and x <> y")
    open_ = open_.select("crowd", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / BLOCK_HASHES, F.least(F.col("n") / 64, F.lit(SPREAD)))).cast("int").alias("blocks"))
    members = durable(crowds.join(open_, "crowd").select("crowd", "node", "root", "blocks"))
    if members.isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list) -> pa.RecordBatch:
            tree, side = (np.array([r[k] for r in rows]) for k in (1, 2))
            links = [sorted((rows[x][1], rows[y][1])) for x, y in joined([r[3] for r in rows], tree, side, similarity)]
            return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], ["a", "b"])

        rows: list = []
        for batch in batches:
            crowd, lo, hi, side, root = (batch.column(k).to_pylist() for k in range(5))
            for i in range(batch.num_rows):
                at = crowd[i], lo[i], hi[i]
                if rows and rows[0][0] != at:
                    yield found(rows)
                    rows = []
                rows.append((at, root[i], side[i], batch.column(5)[i].values.to_numpy().view(np.uint64).copy()))
        if rows:
            yield found(rows)

    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"), F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("crowd", "node", "root", own, other).select("crowd", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root")
    dealt = dealt.join(sets_of(members.select("node").distinct()), "node").select("crowd", "lo", "hi", "side", "root", "held")
    parts = int(crowds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(dealt.repartition(parts, "crowd", "lo", "hi").sortWithinPartitions("crowd", "lo", "hi").mapInArrow(run, "a long, b long").distinct())


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, repeated: bool = True, marked: DataFrame | None = None) -> DataFrame:
    """(node, root, least): each different fingerprint, its group, and its first row as (key is null, key, mark, its set in brief).  ``repeated``: whether rows may be equal; ``marked``: ``prints`` of the rows, where they have been taken."""
    marked = (prints(df, key, text, shingle) if marked is None else marked).select("*", F.xxhash64(*_WORDS).alias("node"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark", "size", *_PARITIES)).alias("least")
    nodes = durable(marked.groupBy("node", *_WORDS).agg(first).select("*", "least.size", *[f"least.{c}" for c in _PARITIES]))

    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("mark"))

    def sets_of(met: DataFrame) -> DataFrame:
        """(node, held): the shingle sets of some nodes."""
        firsts = sized(nodes.join(met, "node", "left_semi").select("node", F.col("least.key").alias("k"), F.col("least.mark").alias("mark")))
        found = texts.join(firsts, "mark").where(F.col("key").eqNullSafe(F.col("k"))).select("node", "text")
        held = durable(sets(found, shingle))
        # repeated rows give a set again; sets are sorted only then, and not while texts are read
        return durable(held.dropDuplicates(["node"])) if repeated else held

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        left, right = held.select(F.col("node").alias("a"), F.col("held").alias("x")), held.select(F.col("node").alias("b"), F.col("held").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        return durable(pairs.join(left, "a").join(right, "b").where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b"))

    ends_of = lambda edges: edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    met = durable(links(nodes.withColumn("tree", F.col("node")), 0, FIRST, 0, similarity))
    edges, cut = met.where("part is null").select("a", "b", "d"), met.where("part is not null")
    candidates = edges.select("a", "b")
    held = sets_of(ends_of(edges))
    ends = edges.union(edges.select("b", "a", "d"))
    nearest = ends.groupBy("a").agg(F.min(F.struct("d", "b")).alias("n")).select(F.least("a", "n.b").alias("a"), F.greatest("a", "n.b").alias("b")).distinct()
    sure = verified(nearest, held)
    roots = grouped(sure)
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
    other = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    sure = sure.union(verified(other, held))
    trees = nodes.join(grouped(sure), "node", "left").withColumn("tree", F.coalesce("root", "node"))
    met = durable(links(trees, FIRST, TABLES, similarity=similarity))
    edges, cut = met.where("part is null").select("a", "b"), cut.union(met.where("part is not null"))
    sure = durable(sure.union(verified(edges, sets_of(ends_of(edges)))))
    trees = durable(nodes.join(grouped(sure), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size"))
    # what a forest or a part may have passed over lies within a component of the candidates or a cell that was cut
    of = lambda end: trees.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
    refused = candidates.union(edges).join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    wide = trees.join(grouped(refused.distinct()).select(F.col("node").alias("root"), F.col("root").alias("crowd")), "root").select("crowd", "node", "root", "size", F.lit(3).alias("few"))
    several = cut.groupBy("a").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("a")
    shared = cut.join(several, "a").select(F.col("a").alias("crowd"), F.col("b").alias("node")).distinct().join(trees, "node").select("*", F.lit(2).alias("few"))
    more = rest(wide.unionByName(shared), sets_of, similarity)
    if more is not None and not more.isEmpty():
        trees = trees.join(grouped(more).select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return nodes.select("node", "least").join(trees.select("node", "root"), "node")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, with all their columns, that stay when each group keeps one: its smallest key's, of those its smallest hash's."""
    read_lightly(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    # the texts are read once for both the fingerprints and this
    marked = durable(prints(df, key, text, shingle))
    repeated = not marked.groupBy("key", "mark").count().where("count > 1").isEmpty()
    stay = groups(df, key, text, shingle, similarity, repeated, marked).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("k"), F.col("least.mark").alias("m"))
    kept = rows.join(stay, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["key", "mark"])
    return kept.select("row.*")
