"""Readers for the stock parquet tables (column-pruned, explicit names)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# key used to spread a table whose scan yields too few splits
KEYS = {"documents": "doc_id", "events": "event_id", "pages": "page_id",
        "conversations": "conv_id", "embeddings": "vec_id", "labels": "doc_id",
        "lineitem": "l_orderkey", "orders": "o_orderkey"}

SPREAD_MIN_BYTES = 4 << 20


def _bytes_on_disk(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def spread(df: DataFrame, key: str, nbytes: int) -> DataFrame:
    """Hash-repartition ``df`` on ``key`` to the cluster's default
    parallelism when its scan yields fewer splits than that and it is big
    enough for the CPU work after it to matter (large Parquet row groups
    cannot be split further).  On a large input with many splits this is a
    no-op: no extra shuffle."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if nbytes < SPREAD_MIN_BYTES:
        return df
    try:
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. no RDD access (Spark Connect): keep the scan
        return df
    if splits >= target:
        return df
    return df.repartition(target, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stock table.  Parquet: filters and projections above this reach
    the scan (PushedFilters / ReadSchema)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    if name in KEYS:
        df = spread(df, KEYS[name], _bytes_on_disk(spark, path))
    return df
