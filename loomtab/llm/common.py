"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000
#: Rows that Parquet's reader holds at once where it reads texts; Spark's own 4096 take 14 MB of common texts a task, three times that while they grow.
READ_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is the cluster's ``spark.checkpoint.dir``.  Only a local
    session that has none gets a temporary one; on a cluster a missing
    setting is an error, as no other folder is known to be shared.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomtab-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, counted first; else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def read_lightly(spark: SparkSession) -> None:
    """Parquet's reader holds at most ``READ_ROWS`` rows from now on.  The setting is the session's: it counts when a plan runs, after a stage has returned it."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, READ_ROWS)


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of a document id's decimal text, as folds use it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """One row per labelled doc_id: (doc_id, y).  Repeated labels are averaged, a mean of 0.5 or more counts as 1; null ids or labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    )
