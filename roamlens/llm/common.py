"""Tables, staging and keys shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts. Spark's batches to Python hold 10,000 rows unless the
    session says otherwise; texts need smaller ones, in the JVM and in Python."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local one would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="roamlens-text-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it again: lineage ends here.

    Spark may drop the shuffle files of the write as soon as it is done; else
    they stay on disk until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, *without: str) -> Column:
    """All columns of a row as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("carried")


def crc_of(id_col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    return text_of(col).cast("binary")
