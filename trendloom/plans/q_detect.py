"""Registered detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import detect
from trendloom.plans.catalog import register
from trendloom.sources import derived
from trendloom.sources.tables import table

# fixed parameters of the registered queries (FIXTURES.md)
MIN_CONFIDENCE = 0.3
NMS_THRESHOLD = 0.3
# linear scorer for the model hook, weights by rule
WEIGHTS = [((i * 7) % 13 - 6) / 10.0 for i in range(64)]


@register("best_class")
def q_best_class(spark, sf):
    return detect.decode_boxes(derived.detections(spark, sf)).select("pos", "class_id", "confidence")


@register("decode_detections")
def q_decode_detections(spark, sf):
    return detect.decode_detections(derived.detections(spark, sf), MIN_CONFIDENCE)


@register("suppress_overlaps")
def q_suppress_overlaps(spark, sf):
    return detect.suppress_overlaps(derived.detections(spark, sf), MIN_CONFIDENCE, NMS_THRESHOLD)


@register("confidence_map")
def q_confidence_map(spark, sf):
    m = detect.confidence_map(derived.detections(spark, sf), derived.class_labels(spark),
                              MIN_CONFIDENCE, NMS_THRESHOLD)
    return m.select("image_id", F.explode("detected").alias("label", "conf")).select(
        "image_id", "label",
        F.array_join(F.transform("conf", lambda c: F.format_string("%.6f", c)), ",").alias("confidences"))


@register("caption_label")
def q_caption_label(spark, sf):
    kept = detect.suppress_overlaps(derived.detections(spark, sf), MIN_CONFIDENCE, NMS_THRESHOLD)
    return detect.caption_labels(kept, derived.class_labels(spark)).select("image_id", "pos", "caption")


@register("score_images")
def q_score_images(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    scored = detect.score_images(emb, detect.linear_scorer(WEIGHTS), "embedding",
                                 ["vec_id", "label"], "vec_id long, label int, score double")
    return scored.select("vec_id", "label", F.round("score", 6).alias("score"))
