"""File-level jobs: the reference's command surface as functions (§2.16).

    collect_batch_job   statuses (JSON) + tracking list + landed assets -> collected table
    collect_detect_job  the same, and a confidence document for every landed image
    clean_job           collected table -> rows whose first image landed (next version)
    posts_job           landed post pages -> (image file, caption) per crawl query
    trending_files_job  collected table + confidence documents + baseline -> tracking list

The output of ``trending_files_job`` is a tracking list in the format
``collect_batch_job`` (and the stream) reads, closing the loop
track -> collect -> detect -> clean -> find terms -> track.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import detect, pages, terms, track
from trendloom.operators import status as st
from trendloom.operators.target import slot_target_flag
from trendloom.schemas import N_SLOTS
from trendloom.sources import files, sinks
from trendloom.streaming.collect import collect_batch, limited


def collect_batch_job(spark: SparkSession, statuses_path: str, out_path: str,
                      tracking_path: str | None = None, assets: DataFrame | None = None,
                      rejects_path: str | None = None, fmt: str = "csv", limit: int | None = None,
                      photos_as_limit: bool = False) -> int:
    """Batch twin of the collection stream; returns the rows written.  With
    ``limit`` only the first rows in (created_at, id) order are kept: that many,
    or as long as their photos stay within it.  The rejects of the input
    replace those of an earlier attempt at the same path."""
    # rejects are an optional audit pass over the same files; the input is
    # not cached (it can be the whole landed history)
    raw = files.read_statuses(spark, statuses_path)
    if rejects_path is not None:
        files.bad_records(raw).write.mode("overwrite").parquet(rejects_path)
    phrases = None if tracking_path is None else track.read_tracking(spark, tracking_path)
    rows = collect_batch(files.good_records(raw), assets, phrases)
    if limit is not None:
        rows = limited(rows, limit, photos_as_limit)
    # counted while written (one pass, nothing cached)
    obs = Observation("collected")
    rows = rows.drop("_photos").observe(obs, F.count(F.lit(1)).alias("n"))
    sinks.write_collected(rows, sinks.current_version(spark, out_path), fmt, "append")
    return int(obs.get["n"])


def detect_landed(rows: DataFrame, images: DataFrame, load_model: Callable, labels: DataFrame,
                  input_col: str = "embedding", min_confidence: float = detect.DEFAULT_MIN_CONFIDENCE,
                  nms_threshold: float = detect.DEFAULT_NMS_THRESHOLD) -> DataFrame:
    """D4 -> D1 -> D2 -> D3 over the landed images of collected rows: one
    confidence document (path, detected) per image.

    ``images`` has (image_file, pos, ``input_col``): what the detector reads, one
    row per image or per proposal; the model hook turns them into raw detector
    rows.  The document's path is the one that the row names for that slot."""
    slots = rows.select(F.explode(F.array(*[F.struct(
        F.col(f"image_file_{i}").alias("image_file"), F.col(f"csv_to_json_file_path_{i}").alias("image_id"))
        for i in range(N_SLOTS)])).alias("s")).select("s.*").where(F.col("image_file").isNotNull()).distinct()
    inputs = slots.join(images, "image_file").select("image_id", "pos", input_col)
    raw = detect.score_images(inputs, load_model, input_col, ["image_id", "pos"],
                              f"image_id string, pos long, {detect.DETECTOR_SCHEMA}")
    documents = detect.confidence_map(raw, labels, min_confidence, nms_threshold)
    return documents.select(F.col("image_id").alias("path"), "detected")


def collect_detect_job(spark: SparkSession, statuses_path: str, out_path: str, confidence_path: str,
                       images: DataFrame, load_model: Callable, labels: DataFrame,
                       min_confidence: float = detect.DEFAULT_MIN_CONFIDENCE,
                       nms_threshold: float = detect.DEFAULT_NMS_THRESHOLD, **collect) -> int:
    """``collect_batch_job`` and then the confidence documents of the collected
    rows' images, as JSON lines keyed by document path."""
    n = collect_batch_job(spark, statuses_path, out_path, **collect)
    rows = files.read_collected(spark, sinks.current_version(spark, out_path))
    documents = detect_landed(rows, images, load_model, labels, min_confidence=min_confidence,
                              nms_threshold=nms_threshold)
    sinks.write_confidences(documents, confidence_path, "overwrite", "path")
    return n


def clean_job(spark: SparkSession, collected_path: str, asset_dir: str, base_dir: str) -> str:
    """Keep the rows whose ``image_file_0`` is a landed file (relative to
    ``base_dir``), as the table's next version."""
    listing = files.list_assets(spark, asset_dir, base_dir)

    def write(df, p):
        sinks.write_collected(df, p, "csv", "overwrite")

    return sinks.rewrite_table(spark, collected_path, files.read_collected,
                               lambda d: st.has_asset(d, listing, "image_file_0", "path"), write)


def posts_job(landed: DataFrame, out_path: str, number: int = 0, query_col: str = "query_dir",
              order: list | None = None) -> None:
    """Landed post pages (query, html) to (image file, caption) rows under one
    folder per crawl query: the first ``number`` posts of each query with an
    image link (0 = all), in ``order``."""
    link = pages.page_meta("html", "og:image")
    order = order or [F.col("page_id")]
    found = landed.select(query_col, *order, link.alias("_link"), pages.page_caption("html").alias("caption"))
    found = found.where(F.col("_link").isNotNull())
    if number:
        found = pages.first_n(found, [query_col], order, number).drop("rank")
    posts = found.select(F.col(query_col).alias("query_dir"), F.concat(
        F.lit("./data/"), F.col(query_col), F.lit("/images/"), F.sha2("_link", 256), F.lit(".jpg")).alias("imagefile"),
        "caption")
    sinks.write_posts(posts, out_path)


def trending_files_job(spark: SparkSession, collected_path: str, confidence_glob: str,
                       base_dir: str | None, baseline: DataFrame, out_path: str,
                       target: str = "aeroplane", threshold: float = 0.5, n: int | None = 400,
                       min_count: int | None = 10) -> DataFrame:
    """Trend terms of the collected rows whose images show ``target``
    (any of the four confidence-document slots), written as a tracking
    list.  Confidence documents are one file each under ``base_dir``, or with
    ``base_dir`` None the JSON lines that ``collect_detect_job`` writes.  Returns
    the ranked terms."""
    rows = files.read_collected(spark, sinks.current_version(spark, collected_path))
    docs = (files.read_confidence_lines(spark, confidence_glob, "path") if base_dir is None
            else files.read_confidence_docs(spark, confidence_glob, base_dir))
    part = (slot_target_flag(rows, docs, target, threshold)
            .where(F.col("has_target")).select("tweet_id", "text"))
    top = terms.trending_terms(part, baseline, n, min_count, "tweet_id", "text")
    sinks.write_tracking(top, out_path)
    return top
