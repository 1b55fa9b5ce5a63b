"""Resumable ingest of arriving files into a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def finished(spark: SparkSession, target: str, keys: Sequence[str], touched: Sequence[int], batch_id: int | None = None) -> DataFrame | None:
    """Work keys that earlier batches finished, in the given buckets: only those folders are listed and read."""
    folders = [f"{target}/keys/bucket={b}" for b in touched if _path_exists(spark, f"{target}/keys/bucket={b}")]
    if not folders:
        return None
    done = spark.read.option("basePath", f"{target}/keys").parquet(*folders)
    return (done if batch_id is None else done.where(F.col("batch") != batch_id)).select(*keys)


def ingest(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], *,
    row_keys: Sequence[str] = (), transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None, buckets: int = 64,
) -> None:
    """Append every new Parquet file under ``source`` to ``target/rows`` once, then stop.

    ``keys`` name a piece of work (a recording, a bout): it is taken whole from the batch that brings it
    first, and skipped later. ``row_keys`` tell its rows apart (by default the keys alone); of several rows
    with one row key the least in column order stays. The checkpoint remembers the files that were read; a
    batch that was written but not yet recorded is replayed into the same ``batch`` folders, which are overwritten.

    ``target/keys`` holds the finished keys by a hash of the key, so a batch reads the folders that its own
    keys fall into, not the target. Choose ``buckets`` for a folder of keys to fit a few files.
    """
    stream = spark.readStream.schema(schema).format("parquet")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    df = stream.load(source)
    names = list(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        d = (transform(batch) if transform else batch).persist()
        work = d.select(*names).distinct().withColumn("bucket", key_bucket(names, buckets)).persist()
        touched = [r.bucket for r in work.select("bucket").distinct().collect()]  # no more than there are buckets
        done = finished(spark, target, names, touched, batch_id)
        new = work if done is None else work.join(done, names, "left_anti")
        one = [*names, *[k for k in row_keys if k not in names]]
        rest = [c for c in d.columns if c not in one]
        rows = d.join(new.select(*names), names, "left_semi").groupBy(*one).agg(F.min(F.struct(*rest)).alias("_r")) if rest else d.join(new.select(*names), names, "left_semi").dropDuplicates(one)
        rows = rows.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in d.columns])
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        dynamic = new.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy("bucket", "batch").parquet(f"{target}/keys")
        work.unpersist()
        d.unpersist()

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
