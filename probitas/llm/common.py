"""Shared pieces of the training-data operators: scratch tables in the cluster's shared folder, table reading."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest Arrow batch handed to a Python worker, so that a run of very long texts stays within memory.
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches by bytes as well as rows. Plans run later, so the setting stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session (tests) gets a temporary one where none is named."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="probitas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/probitas/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def save(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back. Its `scratch` attribute names the path."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def drop_all() -> None:
    """Deletes the scratch tables of this process; call it between jobs of a long-lived session."""
    for spark, path in list(_written):
        if spark._jsc is not None and spark._jsc.sc().isStopped() is False:
            drop(spark, path)


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def sample_ids(rows: DataFrame, group: str, sample: int) -> DataFrame:
    """(group, doc_id): of each group the `sample` ids of least hash (fewer where it has fewer).

    Only ids under a cut of the hash, which is expected to leave twice the sample, are ranked, so no group is in one
    task. Groups are labels or languages: a row each is broadcast.
    """
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    counts = F.broadcast(rows.groupBy(group).agg(F.count("*").alias("_n")))
    few = rows.select(group, "doc_id").join(counts, group).where(mark * F.col("_n") < (2.0 * sample + 200) * 2.0**32).select(group, "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(mark, "doc_id"))
    return few.withColumn("_r", rank).where(F.col("_r") <= sample).select(group, "doc_id")


def join_hot(rows: DataFrame, of: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows joined with `of` (one row a key). Keys that hold over 1/share of the rows, so `share` at most, go by broadcast."""
    least = rows.count() // share
    hot = save(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, 1)).select(key), "hot")
    common = rows.join(F.broadcast(of.join(F.broadcast(hot), key, "left_semi")), key)
    return common.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(of, key))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


Batches = Iterator[pa.RecordBatch]
