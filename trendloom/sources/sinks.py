"""Sinks (K1-K6).  Every write goes through Spark's commit protocol (one
file per task, committed atomically per job); nothing is appended by hand
to a shared file."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.schemas import COLLECTED_COLUMNS
from trendloom.session import written_once

TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# the CSV writer trims surrounding blanks unless told not to
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
               "timestampNTZFormat": TS_NTZ_FORMAT, "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
JSON_OPTIONS = {"timestampNTZFormat": TS_NTZ_FORMAT}
USERS_AT_ONCE = 1 << 14  # users whose folders one task makes, about


def write_collected(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> None:
    """K1: append collected rows (32 columns in header order).  CSV writes
    nulls as empty fields and a header in every part file; Parquet keeps
    types."""
    out = df.select(*COLLECTED_COLUMNS)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)


def write_confidences(df: DataFrame, path: str, mode: str = "append", key: str = "image_id") -> None:
    """K2: one JSON object per image, (key, detected) with every label
    present.  ``key`` is the image's id or the document path that collected
    rows name (``csv_to_json_file_path_i``).  JSON lines in part files (no file
    per image: billions of tiny files would swamp a file system)."""
    df.select(key, "detected").write.mode(mode).options(**JSON_OPTIONS).json(path)


def write_tracking(terms: DataFrame, path: str, term_col: str = "term", rank_col: str = "rank") -> None:
    """K3: ranked terms, one per line, in rank order: the sort's partitions are
    written in order, so a short list is one file and a long one several."""
    (terms.orderBy(rank_col).select(F.col(term_col).alias("value"))
     .write.mode("overwrite").text(path))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


VERSION = "version="


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, ascending (a version is complete when
    Spark's committer has left _SUCCESS in it)."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = sorted(int(n[len(VERSION):]) for n in names if n.startswith(VERSION))
    return [v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(_version_path(path, v) + "/_SUCCESS"))]


def batch_versions(spark: SparkSession, path: str) -> list[int]:
    """The batches whose folder ``batch_id=*`` under ``path`` is complete."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")]
    return sorted(b for b in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch_id={b}/_SUCCESS")))


def _version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/{VERSION}{version:06d}"


def current_version(spark: SparkSession, path: str) -> str:
    """Where the rows of a table are: its newest complete version, or the
    folder itself if it was never rewritten."""
    versions = _versions(spark, path)
    return _version_path(path, versions[-1]) if versions else path


def rewrite_table(spark: SparkSession, path: str, read, transform, write) -> str:
    """K4: replace the table at ``path`` by ``transform(read(current))``.

    The result is written as the next version in a folder of its own (never
    over the files being read) and becomes current with the commit of that one
    write; a crash before leaves the old version, a crash after leaves the new.
    Then older versions are removed, all but the one that was read.  Returns the
    path of that previous version; ``current_version`` finds the new one."""
    versions = _versions(spark, path)
    before = current_version(spark, path)
    after = _version_path(path, versions[-1] + 1 if versions else 1)
    fs, _, jvm = _fs(spark, path)
    target = jvm.org.apache.hadoop.fs.Path(after)
    if fs.exists(target):  # left by a write that was not committed
        fs.delete(target, True)
    obs = Observation("rewrite")  # rows produced, counted during the write
    write(transform(read(spark, before)).observe(obs, F.count(F.lit(1)).alias("n")), after)
    n_expected, n_written = int(obs.get["n"]), read(spark, after).count()
    if n_written != n_expected:
        fs.delete(target, True)
        raise RuntimeError(f"version {after} has {n_written} rows, expected {n_expected}")
    for v in versions[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(_version_path(path, v)), True)
    return before


def existing_partitions(spark: SparkSession, path: str, column: str, kind: T.DataType) -> DataFrame | None:
    """Values of ``column`` already present under ``path`` (the names of its folders: one
    listing, no file is opened), or None if nothing is stored."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    # one string comes over, not one call for each folder; Spark escapes line ends in names
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(p))
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\n")
    names = [line.rsplit("/", 1)[-1] for line in listed.split("\n")]
    values = [_partition_value(n[len(column) + 1:]) for n in names if n.startswith(f"{column}=")]
    return spark.createDataFrame(pa.table({column: pa.array(values, pa.string())})).select(F.col(column).cast(kind))


def _partition_value(name: str) -> str | None:
    """The value that a partition folder's name stands for."""
    if name == "__HIVE_DEFAULT_PARTITION__":
        return None
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def write_user_partitions(spark: SparkSession, users: DataFrame, path: str,
                          key: str = "user_id") -> int:
    """One directory per user (``user_id=<id>``); users with a
    directory already are skipped (left anti join with the stored keys).
    Returns the number of users written.  The new users are written once before, so
    they are counted and computed in one pass; their folders are made by at least as many tasks as
    run at once, as each costs the file system's time and hardly a byte."""
    stored = existing_partitions(spark, path, key, users.schema[key].dataType)
    new = written_once(users if stored is None else users.join(stored, key, "left_anti"), "new-users")
    n = new.count()  # from the files' footers
    if n or stored is None:
        tasks = max(spark.sparkContext.defaultParallelism, n // USERS_AT_ONCE)
        new.repartition(tasks, key).write.mode("append").partitionBy(key).options(**JSON_OPTIONS).json(path)
    return n


def write_posts(posts: DataFrame, path: str, dir_col: str = "query_dir") -> None:
    """K6: (imagefile, caption) rows appended under one directory per crawl
    query; every file carries the header."""
    (posts.select(dir_col, "imagefile", "caption").write.mode("append")
     .partitionBy(dir_col).options(**CSV_OPTIONS).option("multiLine", "true").csv(path))


def write_statuses(statuses: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """Statuses as JSON lines (the stream source's format), micro-second
    timestamps kept.  A compressed file is read by one task."""
    statuses.write.mode(mode).options(**JSON_OPTIONS, compression=compression).json(path)
