"""File sources (S1, S3, S4, S5, S7, S10): explicit schemas, no inference.

All paths may be directories or globs on a shared file system; Spark
splits the files over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom import schemas

CORRUPT = "_corrupt_record"
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
STATUS_WITH_CORRUPT = T.StructType(schemas.STATUS.fields + [T.StructField(CORRUPT, T.StringType())])


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    """S1 (batch twin): JSON lines of nested statuses.  Malformed lines are
    kept with ``_corrupt_record`` set (PERMISSIVE), so one bad record never
    loses the others; split with ``good_records`` / ``bad_records``."""
    return (spark.read.schema(STATUS_WITH_CORRUPT)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("timestampNTZFormat", TS_NTZ_FORMAT).json(path))


def stream_statuses(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as an unbounded file stream; ``max_files_per_trigger``
    bounds the intake per micro-batch (ST6) without dropping anything."""
    r = (spark.readStream.schema(STATUS_WITH_CORRUPT)
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
         .option("timestampNTZFormat", TS_NTZ_FORMAT))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def good_records(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(df: DataFrame) -> DataFrame:
    """Rejected lines (raw text), with whatever id could be parsed.  A query
    may not read only the corrupt-record column of raw files, so ``id_str``
    is kept alongside (persist the parsed input to read both sides once)."""
    return df.where(F.col(CORRUPT).isNotNull()).select("id_str", CORRUPT)


def read_collected(spark: SparkSession, path: str) -> DataFrame:
    """S3: the collected CSV (header, quoted multi-line text)."""
    return (spark.read.schema(schemas.COLLECTED).option("header", True)
            .option("multiLine", True).option("escape", '"').option("quote", '"')
            .option("timestampNTZFormat", TS_NTZ_FORMAT)
            .csv(path))


def read_confidence_docs(spark: SparkSession, path: str, base_dir: str | None = None) -> DataFrame:
    """One JSON object per file (label -> list of confidences) as
    (path, detected).  ``path`` is relative to ``base_dir`` when given, so it
    joins the relative paths stored in the collected table."""
    df = spark.read.text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    rel = full
    if base_dir is not None:
        base = base_dir.rstrip("/") + "/"
        rel = F.regexp_replace(full, "^(file:)?" + _re_escape(base.removeprefix("file:")), "")
    return df.select(rel.alias("path"), F.from_json("value", schemas.CONFIDENCE_DOC).alias("detected"))


def read_confidence_lines(spark: SparkSession, path: str, key: str = "image_id",
                          key_type: T.DataType | None = None) -> DataFrame:
    """S4, table form: JSON lines (key, detected) as written by
    ``sinks.write_confidences``; with ``key="path"`` they join the document
    paths of collected rows."""
    kind = key_type or (T.StringType() if key == "path" else T.LongType())
    schema = T.StructType([T.StructField(key, kind),
                           T.StructField("detected", schemas.CONFIDENCE_DOC)])
    return spark.read.schema(schema).json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Baseline frequency CSV; header skipped, column 0 = term, column 2
    = frequency, the last line of a duplicated term wins.

    Line order is (file, block start, position in the split), so "last"
    holds across splits of one large file."""
    df = (spark.read.schema(schemas.BASELINE_CSV).option("header", True).csv(path)
          .select("term", F.col("freq").cast("double").alias("freq"),
                  F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                           F.monotonically_increasing_id()).alias("_line")))
    return (df.where(F.col("term").isNotNull())
            .groupBy("term").agg(F.max_by("freq", "_line").alias("freq")))


def read_user_partitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K5's folders, one for each user.  Spark would list them in up to 10,000 tasks whatever
    their number; here in eight for each that runs at once."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(schema).json(path)  # lists now
    finally:
        spark.conf.set(name, before)


def list_assets(spark: SparkSession, path: str, base_dir: str | None = None,
                glob: str = "*.jpg") -> DataFrame:
    """Landed files as (path, length); content is pruned away, so only
    the listing is read.  ``path`` relative to ``base_dir`` when given."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(path).select("path", "length"))
    return df if base_dir is None else df.withColumn("path", relative_to(F.col("path"), base_dir))


def relative_to(path: Column, base_dir: str) -> Column:
    """A file's path below ``base_dir``."""
    base = base_dir.rstrip("/") + "/"
    return F.regexp_replace(path, "^(file:)?(//)?" + _re_escape(base.removeprefix("file://").removeprefix("file:")), "")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed pages (page_id, url, html), as a table or as one HTML file
    per page (url = file path)."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html")
    df = spark.read.text(path, wholetext=True)
    return df.select(F.xxhash64(F.col("_metadata.file_path")).alias("page_id"),
                     F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)
