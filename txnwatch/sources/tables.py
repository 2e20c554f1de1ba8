"""Stored tables: replaced all at once, or appended once a run.

A replaced table is a folder of versions and a small file ``_current`` that names the
one to read.  A write fills a new version and then renames a new ``_current`` over the
old one, so readers see the old table or the new one, and a write that dies changes
nothing.  The version before the current one stays for jobs that still read it; older
ones are deleted.

An appended table is partitioned by a run's id; writing a run again replaces that
run's rows and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version to read, or None before the first write."""
    pointer = _path(spark, f"{path}/{POINTER}")
    files = _files(spark, path)
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/{name}"


def _point(spark: SparkSession, path: str, version: str) -> None:
    files, fresh = _files(spark, path), f"{path}/{POINTER}-{version}"
    out = files.create(_path(spark, fresh))
    try:
        out.write(version.encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration()) \
        if "://" in path else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, fresh), _path(spark, f"{path}/{POINTER}"), options)


def replace(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """Make ``df`` the content of the table at ``path`` (the schema may change) and return it re-read;
    ``table`` is also registered in the catalog at the new version."""
    spark, path = df.sparkSession, path.rstrip("/")
    before, version = current(spark, path), f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{version}")
    _point(spark, path, version)
    files = _files(spark, path)
    for status in files.listStatus(_path(spark, path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name != version and f"{path}/{name}" != before:
            files.delete(status.getPath(), True)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")           # external: no file goes
        spark.catalog.createTable(table, path=f"{path}/{version}", source="parquet")
    return spark.read.parquet(f"{path}/{version}")


def read(spark: SparkSession, path: str) -> DataFrame:
    version = current(spark, path.rstrip("/"))
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(version)


def append_run(df: DataFrame, path: str, run: str) -> DataFrame:
    """Add the rows of a run, named by column ``run``, to the log at ``path``; those that the log has of it go."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
    # ids are text, also where they look like numbers
    fields = [f for f in df.schema.fields if f.name != run] + [df.schema[run]]
    schema = type(df.schema)(fields)
    return df.sparkSession.read.schema(schema).parquet(path).select(*[F.col(c) for c in df.columns])
