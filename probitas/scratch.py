"""Scratch tables in the folder that driver and executors share, which cut the lineage of iterations."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session gets a temporary folder where it names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="probitas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back. Its `scratch` attribute names the path, for drop()."""
    spark = df.sparkSession
    path = f"{folder(spark)}/probitas/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def in_order(df: DataFrame, *order) -> DataFrame:
    """df sorted by `order` over all, written down in ranges: with `part`, its range, and `place`, the place within it from 0."""
    mark = F.monotonically_increasing_id()
    return save(df.orderBy(*order).withColumn("_at", mark).withColumns({"part": F.shiftright("_at", 33).cast("int"), "place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its place in the order of all rows, from 1; no task has more than a range of them."""
    rows = in_order(df, *order)
    ends = rows.groupBy("part").agg(F.count("*").alias("k"))
    before = ends.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row a range
    return rows.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def drop(df: DataFrame) -> None:
    """Deletes a scratch table that nothing will read any more."""
    spark, path = df.sparkSession, getattr(df, "scratch", None)
    if path:
        _delete(spark, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_all() -> None:
    """Deletes what this process has left; call it between jobs of a long-lived session."""
    for spark, path in list(_written):
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            _delete(spark, path)
    _written.clear()
