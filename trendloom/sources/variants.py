"""Statuses of drifting shape (S1, P1): each line is kept whole as a VARIANT, and the
fields of the status record are looked up in it by type.

A field that is missing, or holds what its type cannot be made of, is null; a number
that arrives as text (or the other way round) is converted; fields that the record
type does not know stay in the variant and are reported.  Nothing is inferred, so one odd record
changes no other's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom import schemas
from trendloom.sources.files import CORRUPT

RECORD = "record"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record variant, _corrupt_record): one row a line; a line that is no JSON has a
    null record and its text beside it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.try_parse_json("value")
    return lines.select(record.alias(RECORD), F.when(record.isNull(), F.col("value")).alias(CORRUPT))


def _field(record: Column, path: str, kind: T.DataType) -> Column:
    """One field: a struct is taken apart, so that one bad member leaves the others."""
    if isinstance(kind, T.StructType):
        members = [_field(record, f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.schema_of_variant(F.try_variant_get(record, path, "variant")).startswith("OBJECT"), F.struct(*members))
    return F.try_variant_get(record, path, kind.simpleString())


def typed_statuses(records: DataFrame, schema: T.StructType = schemas.STATUS) -> DataFrame:
    """The fields of ``schema`` and the whole ``record``."""
    fields = [_field(F.col(RECORD), f"$.{f.name}", f.dataType).alias(f.name) for f in schema.fields]
    return records.where(F.col(RECORD).isNotNull()).select(*fields, RECORD)


def unknown_fields(records: DataFrame, schema: T.StructType = schemas.STATUS) -> DataFrame:
    """(field, n): how many records hold a top-level field that ``schema`` does not know."""
    spark = records.sparkSession
    found = records.where(F.col(RECORD).isNotNull()).lateralJoin(spark.tvf.variant_explode(F.col(RECORD).outer()))
    return (found.where(~F.col("key").isin([f.name for f in schema.fields]))
            .groupBy(F.col("key").alias("field")).agg(F.count(F.lit(1)).alias("n")))
