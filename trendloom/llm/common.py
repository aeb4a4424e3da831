"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import scratch_path, ship_package

#: The two word classes of the contracts, as Java regex classes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stock table; the Python workers get this package with the first one."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is
    evaluated once however often ``body`` names it (Catalyst would substitute
    a plain alias into every lambda below it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced_words(text: Column) -> Column:
    """The space-separated words of ``text``: runs of characters outside the
    white-space class (empty array for null)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def plain_words_text(text: Column) -> Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z,
    joined by single spaces ('' for null or no word)."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), NON_WORD_CLASS, " ")
    return F.translate(F.trim(spaced), UPPER, LOWER)


def words_of(joined: Column) -> Column:
    """The array of words of a single-spaced string ('' has none)."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text: Column) -> Column:
    """Hash that tells apart rows which share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the session's shared checkpoint folder
    and read again: a lineage cut that survives lost executors, and a table
    whose size Spark knows when it plans joins."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table made by ``stored``."""
    spark, total = df.sparkSession, 0
    for f in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += int(fs.getFileStatus(path).getLen())
    return total
