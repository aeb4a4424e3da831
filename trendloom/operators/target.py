"""Target partition (F5, J3, A7): keep the rows whose image(s) show the
target class above a confidence threshold.

Detection results come in long form (image_id, label, confidence).  The
filter on label and confidence runs at the scan; the surviving image ids
drive a left-semi join, so each row is tested once and nothing per-row is
opened or looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def target_images(confidences: DataFrame, target: str, threshold: float = 0.5,
                  image_col: str = "image_id") -> DataFrame:
    """Image ids with any ``target`` confidence strictly above threshold.
    Images with an empty list or without the label are simply absent."""
    return (confidences.where((F.col("label") == target) & (F.col("confidence") > threshold))
            .select(image_col).distinct())


def target_partition(rows: DataFrame, confidences: DataFrame, target: str,
                     threshold: float = 0.5, key: str = "doc_id",
                     image_col: str = "image_id") -> DataFrame:
    """Rows whose ``key`` names an image with the target detected."""
    hits = confidences.where((F.col("label") == target) & (F.col("confidence") > threshold))
    return rows.join(hits.select(F.col(image_col).alias(key)), key, "left_semi")


def with_target_flag(rows: DataFrame, confidences: DataFrame, target: str,
                     threshold: float = 0.5, key: str = "doc_id",
                     image_col: str = "image_id", flag: str = "has_target") -> DataFrame:
    """Rows plus a boolean flag; missing images count as false."""
    hits = target_images(confidences, target, threshold, image_col).select(
        F.col(image_col).alias(key), F.lit(True).alias(flag))
    return (rows.join(hits, key, "left")
                .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def partition_report(rows: DataFrame, confidences: DataFrame, target: str,
                     threshold: float = 0.5, key: str = "doc_id",
                     image_col: str = "image_id") -> DataFrame:
    """One row (n_rows, n_target) in a single pass."""
    flagged = with_target_flag(rows, confidences, target, threshold, key, image_col)
    return flagged.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.count_if(F.col("has_target")).alias("n_target"))


def slot_target_flag(rows: DataFrame, docs: DataFrame, target: str, threshold: float = 0.5,
                     key: str = "tweet_id", slots: int = 4,
                     path_prefix: str = "csv_to_json_file_path_",
                     flag: str = "has_target") -> DataFrame:
    """J3 on the collected table: a row has the target when any of its
    confidence-document slots names a document (``docs``: path, detected
    map) with a target confidence above threshold; missing files and empty
    lists are false.

    The slots are exploded (at most ``slots`` per row), joined to the
    documents on path and reduced with ``bool_or`` per row key.
    """
    paths = rows.select(key, F.explode(F.array(*[F.col(f"{path_prefix}{i}") for i in range(slots)]))
                        .alias("path")).where(F.col("path").isNotNull() & (F.col("path") != ""))
    found = F.coalesce(F.exists(F.col("detected")[target], lambda c: c > threshold), F.lit(False))
    hits = (paths.join(docs.select("path", found.alias("_hit")), "path")
            .groupBy(key).agg(F.bool_or("_hit").alias(flag)))
    return (rows.join(hits, key, "left")
                .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))
