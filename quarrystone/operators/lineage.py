"""Cutting the lineage of iterative operators, and joins that never gather a table at the driver."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder that the session names, or, where it names none, kept by Spark with their
    lineage; either way plans of later rounds don't hold those of earlier ones."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def written(df: DataFrame) -> DataFrame:
    """As ``settled``, for tables that grow with the input: columns of a Parquet table take a fraction of a checkpoint's disk, and the
    shuffles of the run that wrote it are freed at once."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df.persist()
    folder, key = f"{shared_folder(spark)}.parquet", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """The rows for a join of two tables that both grow with the input: it shuffles both. Spark guesses sizes from compressed bytes, and
    would collect the smaller one at the driver to broadcast it though it is many times larger there."""
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the folder of ``spark.checkpoint.dir``. Only a session on one machine (tests) may name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/quarrystone"
    return f"{found.rstrip('/')}/files-{uuid.uuid4().hex}"
