"""A folder for intermediate tables that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver ends.

    Only local sessions get a folder of their own where that is unset.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sparklex-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(release, spark)
    _made[app].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; results that read them can't be used afterwards."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    for path in _made.pop(context.applicationId, []):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
