"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where it is unset, as in tests, an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='corpus-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written as Parquet to the shared folder and read again.

    Later steps read finished files: a lost executor costs its running tasks only. The files
    stay as long as the folder does, as a result may be read at any later time.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(df: DataFrame, of: int, least: int = 1) -> int:
    """Partitions for ``of`` bytes at about 64 MB each, and no fewer than the session's setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-of // (64 << 20)))
