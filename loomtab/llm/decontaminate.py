"""Benchmark decontamination: SimHash over item-sized windows, in DataFrame operations alone.

A text and an item are their words, lower-cased and cut at white space; an item
of n words is held against every window of n words of a document, by the
multisets of their five-word shingles (an item of fewer words is one shingle).

1. Every document's shingles are hashed and meet the items that hold them in a
   join with the items' shingles, which are broadcast in parts of about
   ``SHINGLES``, a pass a part.  What goes on from a meeting is the stretch of
   the document around it that a window could cover, never the whole document.
2. Around each meeting, windows of the item's length whose first shared shingle
   is the one that met are cut out, so each window comes once: a window of m
   shingles at similarity s or more misses at most m - 2ms/(1+s) of them, so no
   other start can pass.  A document of l < m shingles is one window by itself,
   which misses at most l - (l+m)s/(1+s), and goes from there straight to
   step 4.
3. Each window gets a 64-bit SimHash.  Window and item fingerprints are cut
   into ``radius`` + 1 blocks; two within ``radius`` bits agree in at least one
   block, so a join on (item, block, value) misses none of them.
4. What is within the radius is verified by the weighted Jaccard similarity of
   the two multisets, least counts over greatest counts.

The radius is the one place where a window over the threshold could be lost: at
similarity 0.8 fingerprints differ in about 10 bits, with deviation 3; the
default of 24 is five deviations off, less than one window in a million.

Defined cases: null and wordless texts and items match nothing; an item shorter
than five words matches as a whole; texts are read whole; repeated documents or
items are listed once a pair of ids, null ids like any other; ties in
similarity go to the first window; an empty table on either side gives no rows;
further columns are left aside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import durable, sized

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
#: Shingles of items that are broadcast at once, about: 16 bytes each, and once more with their items.
SHINGLES = 500_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    spaced = F.trim(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingles(of: Column, size: int) -> Column:
    """XXH64 of every ``size`` words in a row, in order."""
    starts = F.when(F.size(of) >= size, F.sequence(F.lit(0), F.size(of) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(size)]))


def simhash(hashes: Column, most: int) -> Column:
    """64-bit SimHash of an array of hashes of at most ``most`` elements: a bit is set if it is in over half of them.

    Counts of several bits share a long, in lanes as wide as ``most`` needs.
    """
    lane = next(x for x in (8, 16, 32, 64) if most < 1 << (x - 1) or x == 64)
    mask = sum(1 << i for i in range(0, 64, lane))
    mask -= 1 << 64 if mask >> 63 else 0

    def lane_sum(j: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask).cast("long")))

    sums = [lane_sum(j) for j in range(lane)]
    full = F.lit((1 << lane) - 1 if lane < 64 else -1).cast("long")

    def bits(parts: Column, size: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(64):
            count = F.shiftrightunsigned(F.get(parts, F.lit(b % lane)), b // lane * lane).bitwiseAND(full)
            out = out.bitwiseOR(F.shiftleft((2 * count > size).cast("long"), b))
        return out

    # never null, so the joins that follow need not test it
    return F.coalesce(F.get(F.transform(F.array(F.array(*sums)), lambda parts: bits(parts, F.size(hashes))), F.lit(0)), F.lit(0).cast("long"))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets."""
    plain = F.size(F.array_intersect(a, b))
    counted = F.aggregate(F.array_distinct(b), F.lit(0), lambda t, x: t + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    shared = F.when((F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b)), plain).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 blocks that cover 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(fp: Column, radius: int) -> Column:
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (at, width) in enumerate(_blocks(radius))]
    return F.array(*parts)


def _first_shared(differing: Column, radius: int) -> Column:
    """The first block in which two fingerprints with this XOR agree."""
    out = F.lit(-1)
    for k, (at, width) in reversed(list(enumerate(_blocks(radius)))):
        out = F.when(F.shiftrightunsigned(differing, at).bitwiseAND(F.lit((1 << width) - 1)) == 0, k).otherwise(out)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, item, similarity, word): each document that holds an item, the best window's similarity and the number of words before it."""
    asked = benchmark.select(F.col(f"`{item}`").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).select("item", "w", F.size("w").alias("n")).where("n > 0")
    # five-word shingles, and for shorter items their whole length; a row a length, at most five
    lengths = sorted(asked.groupBy(F.least("n", F.lit(SHINGLE)).alias("size")).agg(F.max("n").alias("longest"), F.sum("n").alias("held")).collect())
    if not lengths:
        return documents.select(F.col(f"`{key}`").alias(key), F.lit(None).cast(benchmark.schema[item].dataType).alias(item), F.lit(0.0).alias("similarity"), F.lit(0).alias("word")).where("false")
    found = None
    for size, longest, held in lengths:
        some = asked.where(F.col("n") == size if size < SHINGLE else F.col("n") >= size)
        parts = -(-held // SHINGLES)
        for part in range(parts):
            asking = some.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else some
            pairs = _matches(documents.select(F.col(f"`{key}`").alias("doc"), words(F.col(f"`{text}`")).alias("w")), asking, size, longest - size + 1, threshold, radius)
            found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"))).alias("best"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("word"))


def _matches(documents: DataFrame, asked: DataFrame, size: int, most: int, threshold: float, radius: int) -> DataFrame:
    """(doc, item, similarity, at) of all windows over the threshold, for items of at most ``most`` shingles of ``size`` words."""
    items = asked.select("item", (F.col("n") - size + 1).alias("m"), shingles(F.col("w"), size).alias("own"))
    # repeated items: every text of an id asks for itself
    items = items.select(F.xxhash64("item", "own").alias("ask"), "item", "m", "own").select("*", simhash(F.col("own"), most).alias("item_fp"))
    items = durable(items.dropDuplicates(["ask"]))  # worked out once
    # outer explosions throughout: for an inner one the optimiser would put all that makes the array once more into a filter
    postings = items.select("ask", F.explode_outer(F.array_distinct("own")).alias("hash"))
    small = postings.limit(2 * SHINGLES + 1).count() <= 2 * SHINGLES  # else one item alone is that long
    prints, items = items.select("ask", "item_fp"), items.drop("item_fp")
    postings, items = (F.broadcast(postings), F.broadcast(items)) if small else (postings, items)
    # how many of its shingles a window over the threshold may miss; a document with fewer than m is its own window
    slack = lambda length, m: F.floor(length - (length + m) * threshold / (1 + threshold) + 1e-9).cast("int")
    reach = int(most - 2 * most * threshold / (1 + threshold) + 1e-9)
    hashed = documents.select("doc", shingles(F.col("w"), size).alias("all"))
    each = hashed.select("doc", "all", F.posexplode_outer("all").alias("at", "hash")).join(postings, "hash").join(items, "ask")
    off = F.greatest(F.col("at") - reach, F.lit(0))
    met = each.select("doc", "ask", "item", "m", "own", "at", F.size("all").alias("total"), off.alias("off"), F.slice("all", off + 1, F.col("at") - off + most).alias("around"))
    short = F.col("total") < F.col("m")
    length = F.least("total", "m")
    low = F.greatest(F.col("at") - slack(length, F.col("m")), F.lit(0))
    ahead = met.select("*", length.alias("length"), low.alias("low"), F.slice("around", low - F.col("off") + 1, F.greatest(F.col("at") - low, F.lit(0))).alias("before"))
    shared = F.array_max(F.transform("before", lambda h, i: F.when(F.array_contains("own", h), i)))
    first = F.col("low") + F.coalesce(shared + 1, F.lit(0))
    last = F.when(short, F.lit(0)).otherwise(F.least(F.col("at"), F.col("total") - F.col("m")))
    ranges = ahead.select("doc", "ask", "item", "own", "length", "off", "around", short.alias("short"), first.alias("first"), last.alias("last")).where("last >= first")
    starts = ranges.select("doc", "ask", "item", "own", "length", "off", "around", "short", F.explode_outer(F.sequence("first", "last")).alias("at"))
    windows = starts.select("doc", "ask", "item", "own", "short", "at", F.slice("around", F.col("at") - F.col("off") + 1, F.col("length")).alias("window"))
    printed = windows.select("*", simhash(F.col("window"), most).alias("fp"))
    # a document that is its own window goes straight to the last step, and no radius can lose it
    alone = F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("value")))
    cut = printed.select("doc", "ask", "item", "own", "at", "window", "fp", F.explode_outer(F.when(F.col("short"), alone).otherwise(_keys(F.col("fp"), radius))).alias("key")).select("doc", "ask", "item", "own", "at", "window", "fp", "key.*")
    index = prints.select("ask", "item_fp", F.explode_outer(F.concat(_keys(F.col("item_fp"), radius), alone)).alias("key")).select("ask", "item_fp", "key.*")
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    close = cut.join(sized(index), ["ask", "block", "value"]).where((F.col("block") == -1) | (F.bit_count(differing) <= radius) & (F.col("block") == _first_shared(differing, radius)))
    return close.select("doc", "item", "at", similarity(F.col("window"), F.col("own")).alias("similarity")).where(F.col("similarity") >= threshold)


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` whose id is not listed, with all their columns."""
    found = contaminated(documents, benchmark, key, **options).select(F.col(key).alias("__found")).distinct()
    return documents.join(found, documents[key].eqNullSafe(found["__found"]), "left_anti")
