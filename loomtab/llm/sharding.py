"""Shards cut from a Hilbert curve over quantised metadata.

Each row's metadata (by default language, source and size) are quantised to
``BITS`` bits a dimension, in order: a string by the share of the column's
distinct values that come before it, a count by the size of its logarithm, so
a cell covers a run of values in every dimension.  The cell has an index on
the Hilbert curve, along which neighbours differ by one step in one dimension.
Rows are put in order of that index and the order is cut into runs of equal
length, so a shard covers a compact piece of the metadata space and a reader
that filters on several dimensions skips most shards.  Law: ``rows``, the
counts of any two shards differ by one at most.

No row is sorted globally and nothing is kept between passes, so any task can
be done again: a count of the cells gives each cell's first rank; a cell's rows
are spread over buckets of about ``BUCKET_ROWS`` by a hash that also orders
them (a cell with a third of all rows is many buckets); a count of the buckets
gives each bucket's first rank; and each bucket numbers its own rows.

Defined cases: a null text has size 16 and CRC 0; null metadata count as empty
strings; strings alike in the four hexadecimal digits after the column's common
prefix fall into one cell; ties in place, hash, key, CRC and size are rows that
no result can tell apart, and share a bucket; null ids and repeated ids are
rows like any other, also when shards are written; an empty table gives no
rows; further columns are left aside, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.llm.common import BROADCAST_ROWS, table

BITS = 4
SHARDS = 40
#: Rows of one cell that are numbered together, about.
BUCKET_ROWS = 1000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a cell on the Hilbert curve (Skilling, 2004): undo the excess work of each level from the top, Gray-code, and interleave."""
    x, n = list(point), len(point)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = 0, 1 << (bits - 1)
    while bit > 1:
        if x[-1] & bit:
            flip ^= bit - 1
        bit >>= 1
    x = [v ^ flip for v in x]
    return functools.reduce(lambda out, b: out << 1 | b, (v >> k & 1 for k in reversed(range(bits)) for v in x), 0)


@functools.cache
def curve(dimensions: int, bits: int) -> tuple[int, ...]:
    """The index of every cell, cells numbered by their coordinates as digits, the first foremost; at most 2**16 cells."""
    if dimensions * bits > 16:
        raise ValueError("more than 65536 cells")
    side = (1 << bits) - 1
    return tuple(hilbert_index(tuple(cell >> bits * (dimensions - 1 - k) & side for k in range(dimensions)), bits) for cell in range(1 << dimensions * bits))


def _hex(value: Column) -> Column:
    return F.hex(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def ordered(df: DataFrame, column: str) -> Column:
    """A string quantised in order, equal shares of the column's distinct values to each of the 2**BITS steps.

    Values are told apart by the four hexadecimal digits after the prefix that
    all share, so what comes to the driver are at most 69,905 counts.
    """
    values = df.select(_hex(F.col(f"`{column}`")).alias("h")).distinct()
    low, high = values.agg(F.min("h"), F.max("h")).first()
    if low is None:
        return F.lit(0)
    shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    heads = sorted(values.groupBy(F.substring("h", shared + 1, 4).alias("head")).count().collect())
    total, before, bounds = sum(n for _, n in heads), 0, {}
    for head, n in heads:
        bounds.setdefault((before << BITS) // total, head)
        before += n
    head = F.substring(_hex(F.col(f"`{column}`")), shared + 1, 4)
    return functools.reduce(lambda out, step: F.when(head >= bounds[step], step).otherwise(out), sorted(bounds), F.lit(0))


def magnitude(value: Column) -> Column:
    """A count below 2**32 quantised by its number of binary digits, two to a step."""
    return F.least(F.shiftright(F.length(F.bin(value)) - 1, 1), F.lit((1 << BITS) - 1))


def _placed(df: DataFrame, dimensions: dict[str, Column], key: str, text: str, count: int, whole: bool) -> DataFrame:
    """(key, size, crc, shard, slot, dims, row) for every row; ``row`` holds all of its columns if ``whole``."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    dims = [d.cast("int").alias(f"d{i}") for i, d in enumerate(dimensions.values())]
    names = [f"d{i}" for i in range(len(dims))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if whole else F.lit(None).cast("int")
    shown = df.select(F.col(f"`{key}`").alias("key"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("crc"), *dims, row.alias("row"))
    cell = functools.reduce(lambda a, b: F.shiftleft(a, BITS).bitwiseOR(b), [F.col(n) for n in names])
    # a row a cell: its place on the curve, the rows before it and its buckets; at most 2**16 cells
    counts = dict(df.select(*dims).groupBy(cell.alias("cell")).count().collect())
    index, before, cells = curve(len(dims), BITS), 0, []
    for c in sorted(counts, key=index.__getitem__):
        cells.append((c, before, -(-counts[c] // BUCKET_ROWS)))
        before += counts[c]
    buckets = sum(b for _, _, b in cells)
    cells = df.sparkSession.createDataFrame(cells, "cell int, before long, buckets long")
    told = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("crc"), F.col("size"))
    mixed = shown.select("*", cell.alias("cell"), F.crc32(told.cast("binary")).alias("mix")).join(F.broadcast(cells), "cell")
    dealt = mixed.withColumn("bucket", F.shiftright(F.col("mix") * F.col("buckets"), 32))
    sizes = dealt.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("cell", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    firsts = F.broadcast(firsts) if buckets <= BROADCAST_ROWS else firsts  # at most a row a bucket
    number = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("mix", "key", "crc", "size")) - 1
    ranked = dealt.join(firsts, ["cell", "bucket"]).select("key", "size", "crc", *names, "row", (F.col("before") + F.col("inside") + number).alias("rank"))
    n = F.lit(before).cast("long")
    shard = F.call_function("div", F.col("rank") * count, n)
    cut = ranked.withColumn("shard", shard.cast("int"))
    first = F.call_function("div", F.col("shard") * n + (count - 1), F.lit(count).cast("long"))
    return cut.select("key", "size", "crc", "shard", (F.col("rank") - first).alias("slot"), *names, "row")


def shards(df: DataFrame, dimensions: dict[str, Column], key: str = "doc_id", text: str = "text", count: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row; ``dimensions`` are integers below 2**BITS."""
    placed = _placed(df, dimensions, key, text, count, False)
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write(df: DataFrame, dimensions: dict[str, Column], path: str, key: str = "doc_id", text: str = "text", count: int = SHARDS, folder: str = "curve_shard") -> DataFrame:
    """All rows of ``df`` under ``path``, one folder ``<folder>=n`` a shard, in order of slot; returns the manifest.

    Should ``df`` have a column of the folder's name, the folder's gets underscores.
    The manifest has a row a shard: its row count and each dimension's steps as
    a bit set, by which a reader picks the shards it needs.
    """
    while folder in df.columns:
        folder += "_"
    placed = _placed(df, dimensions, key, text, count, True)
    dealt = placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias(folder)).write.mode("overwrite").partitionBy(folder).parquet(path)
    return manifest(df, dimensions, key, text, count)


def manifest(df: DataFrame, dimensions: dict[str, Column], key: str = "doc_id", text: str = "text", count: int = SHARDS) -> DataFrame:
    """(shard, rows, a bit set for each dimension)."""
    placed = _placed(df, dimensions, key, text, count, False)
    sets = [F.bit_or(F.call_function("shiftleft", F.lit(1), F.col(f"d{i}"))).alias(n) for i, n in enumerate(dimensions)]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *sets)


def needed(manifest: DataFrame, **wanted: set[int]) -> DataFrame:
    """The shards that can hold rows whose dimensions are among the wanted steps."""
    for name, values in wanted.items():
        manifest = manifest.where(F.col(name).bitwiseAND(F.lit(sum(1 << v for v in values))) != 0)
    return manifest.select("shard")


def metadata(documents: DataFrame) -> dict[str, Column]:
    """The dimensions of ``documents``: language, source and size."""
    size = F.coalesce(F.length(F.col("text").cast("binary")), F.lit(0)) + 16
    return {"lang": ordered(documents, "lang"), "source": ordered(documents, "source"), "size": magnitude(size)}


def documents_by_curve(spark, sf_dir: str) -> DataFrame:
    """``documents`` in shards by language, source and size."""
    documents = table(spark, sf_dir, "documents")
    return shards(documents, metadata(documents))


def _crc_table(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (value & 1) * 0xEDB88320
    return value


def oracle() -> str:
    """DuckDB SQL for ``documents_by_curve``: CRC-32 byte by byte (its table is linear in a byte's bits), the curve as a list, ranks by one window."""
    low = "CAST(xor(a, v) & 255 AS BIGINT)"
    step = functools.reduce(lambda out, k: f"xor({out}, ({low} >> {k} & 1) * {_crc_table(1 << k)})", range(8), "a >> 8")

    def crc(raw: str) -> str:
        octets = f"list_transform(regexp_extract_all({raw}, '..'), lambda o: CAST('0x' || o AS BIGINT))"
        return f"xor(list_reduce({octets}, lambda a, v: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"

    def steps(name: str) -> str:
        return f"""{name}v AS (SELECT DISTINCT {name} AS h FROM b), {name}k AS (SELECT max(k) AS k FROM (SELECT min(h) AS a, max(h) AS z FROM {name}v), range(0, 4000) t(k) WHERE k <= length(a) AND k <= length(z) AND left(a, k) = left(z, k)),
{name}s AS (SELECT substring(h, k + 1, 4) AS head, count(*) AS n FROM {name}v, {name}k GROUP BY 1), {name}q AS (SELECT head, coalesce(sum(n) OVER (ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16 // sum(n) OVER () AS step FROM {name}s),
{name}d AS (SELECT h, CAST(step AS BIGINT) AS step FROM {name}v, {name}k JOIN {name}q ON head = substring(h, k + 1, 4))"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
b AS (SELECT doc_id, octet_length(encode(text)) + 16 AS size, hex(encode(text)) AS x, hex(encode(lang)) AS lang, hex(encode(source)) AS source FROM d),
{steps("lang")},
{steps("source")},
c AS (SELECT doc_id, size, {crc("x")} AS text_crc32, l.step AS lang, s.step AS source, least((length(bin(size)) - 1) // 2, 15) AS magnitude FROM b JOIN langd l ON l.h = b.lang JOIN sourced s ON s.h = b.source),
m AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size)) AS told FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY place, mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER () AS n
  FROM (SELECT *, {crc("told")} AS mix, {list(curve(3, BITS))}[lang * 256 + source * 16 + magnitude + 1] AS place FROM m))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * {SHARDS} // n AS INTEGER) AS shard,
  CAST(rank - (rank * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r
"""
