"""Image-detection post-processing.

Input rows are raw detector outputs: (image_id, pos, w, h, vec) with
vec = [cx, cy, bw, bh, objectness, score_0, ...] normalised to 0..1 and
``pos`` the output order.  All steps but the model hook are Catalyst
expressions (higher-order functions), so they run in codegen.

Group sizes: an image of up to ``FOLD_BOXES`` candidates is folded as one group;
a crowded one is decided in rounds over a grid of cells (``_decide_crowded``), so no image has to
be folded in one task.  The per-image confidence map is one document per image by
definition and is assembled from the kept boxes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.operators.prefix import ordinal
from trendloom.session import checkpoint_dir, ship_package

DEFAULT_MIN_CONFIDENCE = 0.5
DEFAULT_NMS_THRESHOLD = 0.3
FOLD_BOXES = 1000  # candidates that are folded as one group
MAX_LEVEL = 32  # box sizes are 32-bit

_BOX = "struct<k:double,pos:bigint,confidence:double,class_id:int,x:int,y:int,bw:int,bh:int>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Class names, one per line; position (0-based) is the class id.
    A single text file keeps line order within its one split."""
    df = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace(F.col("value"), r"\n$", ""), "\n")
    return df.select(F.posexplode(lines).alias("class_id", "label")).select(
        F.col("class_id").cast("int"), "label")


def decode_boxes(raw: DataFrame) -> DataFrame:
    """A8 + P8 for every row: best class (first index wins ties), its score
    as confidence, and the integer box (x, y, bw, bh) in pixels."""
    vec = F.col("vec")
    scores = F.slice(vec, 6, F.size(vec) - 5)
    conf = F.array_max(scores)
    cx = (F.get(vec, 0) * F.col("w")).cast("int")
    cy = (F.get(vec, 1) * F.col("h")).cast("int")
    bw = (F.get(vec, 2) * F.col("w")).cast("int")
    bh = (F.get(vec, 3) * F.col("h")).cast("int")
    return raw.select(
        "image_id", "pos",
        (F.array_position(scores, conf) - 1).cast("int").alias("class_id"),
        conf.alias("confidence"),
        (cx - bw / 2.0).cast("int").alias("x"),
        (cy - bh / 2.0).cast("int").alias("y"),
        bw.alias("bw"), bh.alias("bh"),
    )


def decode_detections(raw: DataFrame, min_confidence: float = DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """Decoded boxes whose class score is strictly above the threshold
    (the objectness element is not used)."""
    return decode_boxes(raw).where(F.col("confidence") > min_confidence)


def _iou_f32(a: Column, b: Column) -> Column:
    """Overlap of two integer boxes, as the suppression compares it: a
    32-bit float of inter / (area_a + area_b - inter); 0 when the union is 0."""
    ix = F.greatest(F.lit(0), F.least(a["x"] + a["bw"], b["x"] + b["bw"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0), F.least(a["y"] + a["bh"], b["y"] + b["bh"]) - F.greatest(a["y"], b["y"]))
    inter = ix.cast("double") * iy.cast("double")
    union = (a["bw"].cast("double") * a["bh"] + b["bw"].cast("double") * b["bh"]) - inter
    ratio = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return (F.lit(1.0) - (F.lit(1.0) - ratio)).cast("float")


def _fold(sorted_boxes: Column, nms_threshold: float) -> Column:
    """Greedy pass over boxes sorted by (confidence desc, pos): keep a box
    unless a kept one overlaps it by more than the threshold."""
    t = F.lit(nms_threshold).cast("float")
    return F.aggregate(
        sorted_boxes, F.array().cast(f"array<{_BOX}>"),
        lambda acc, c: F.when(F.exists(acc, lambda k: _iou_f32(k, c) > t), acc)
                        .otherwise(F.concat(acc, F.array(c))))


def _folded(boxes: DataFrame, nms_threshold: float) -> DataFrame:
    """Each image folded as one group; kept boxes with ``_r``, their place among
    those of the image from 0."""
    box = F.struct((-F.col("confidence")).alias("k"), F.col("pos").cast("long").alias("pos"),
                   F.col("confidence"), F.col("class_id"), "x", "y", "bw", "bh")
    grouped = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("_cand"))
    return (grouped.select("image_id", F.posexplode(_fold(F.col("_cand"), nms_threshold)).alias("_r", "b"))
            .select("image_id", "_r", *[f"b.{c}" for c in _KEPT]))


_KEPT = ("pos", "class_id", "confidence", "x", "y", "bw", "bh")


def _with_cells(boxes: DataFrame, nms_threshold: float) -> DataFrame:
    """Adds ``cells``: the grid cells (image, level, cx, cy) of a box; null if it has no area.

    At level L cells are squares of 2^L pixels.  A box whose longer side is at most
    2^L, and more than half of that, covers at most four cells there.  Two boxes can
    only overlap by more than t if each side of one is more than t times that of the
    other, so a box is listed at its own level and at those up to log2(1/t) above: two
    boxes that overlap by more than t share a cell at the level of the larger one."""
    up = MAX_LEVEL if nms_threshold <= 0 else min(MAX_LEVEL, math.ceil(-math.log2(min(nms_threshold, 1.0) * (1 - 1e-6))))
    side = F.greatest("bw", "bh").cast("long")
    own = F.when(side <= 1, F.lit(0)).otherwise(F.length(F.bin(side - 1)))

    def span(lo: str, size: str, level: Column) -> Column:
        cell = lambda v: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")
        return F.sequence(cell(F.col(lo)), cell(F.col(lo).cast("long") + F.col(size) - 1))

    at = lambda level: F.flatten(F.transform(span("x", "bw", level), lambda cx: F.transform(
        span("y", "bh", level), lambda cy: F.struct("image_id", level.alias("level"), cx.alias("cx"), cy.alias("cy")))))
    levels = F.sequence(own, F.least(own + F.lit(up), F.lit(MAX_LEVEL)))
    return (boxes.withColumn("own", own)
            .withColumn("cells", F.when((F.col("bw") > 0) & (F.col("bh") > 0), F.flatten(F.transform(levels, at)))))


def _decide_crowded(boxes: DataFrame, nms_threshold: float) -> DataFrame:
    """Kept boxes of images of any size, decided in rounds.

    Two boxes that overlap by more than the threshold share a cell of the level of at
    least one of them, its owner.  So a box is kept if no better undecided box shares a cell
    that either of the two owns.  A kept box then removes what it overlaps by more than the
    threshold, among those that share such a cell.  A cell gets one kept owner a round, also where all
    boxes lie on one place; pairs of undecided boxes are never listed.
    Once few are left they are folded by image.  The number of rounds is that of the longest
    chain of ever worse boxes from cell to cell, a few where confidence does not follow the place.
    Only the number of undecided boxes reaches the driver."""
    t = F.lit(nms_threshold).cast("float")
    rank = F.struct((-F.col("confidence")).alias("k"), F.col("pos").cast("long").alias("pos"), "confidence",
                    "class_id", "x", "y", "bw", "bh", "uid")
    todo = (_with_cells(boxes.withColumn("uid", F.monotonically_increasing_id()).checkpoint(), nms_threshold)
            .select("image_id", "own", "cells", "uid", rank.alias("box")))
    # without area: overlaps nothing
    kept = todo.where("cells IS NULL").select("image_id", "box")
    todo = todo.where("cells IS NOT NULL")
    while True:
        seen = Observation("undecided")
        todo = todo.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
        if int(seen.get["n"]) <= FOLD_BOXES:
            break
        rows = (todo.select("image_id", "uid", "box", "own", F.explode("cells").alias("cell"))
                .withColumn("own", F.col("own") == F.col("cell.level")))
        best = rows.groupBy("cell").agg(F.min("box").alias("_any"), F.min(F.when(F.col("own"), F.col("box"))).alias("_own"))
        better = F.when(F.col("own"), F.col("_any") < F.col("box")).otherwise(
            F.coalesce(F.col("_own") < F.col("box"), F.lit(False)))
        beaten = rows.join(best, "cell").groupBy("uid").agg(F.bool_or(better).alias("_beaten"))
        new = todo.join(beaten.where(~F.col("_beaten")), "uid", "left_semi").checkpoint()
        kept = kept.unionByName(new.select("image_id", "box"))
        winners = (new.select(F.col("box").alias("_w"), "own", F.explode("cells").alias("cell"))
                   .select("_w", "cell", (F.col("own") == F.col("cell.level")).alias("_owner")))
        hit = _iou_f32(F.col("_w"), F.col("box")) > t
        lost = (rows.join(winners.where("_owner"), "cell").where(hit).select("uid")
                .unionByName(rows.where("own").join(winners.where("NOT _owner"), "cell").where(hit).select("uid"))
                .unionByName(new.select("uid")).distinct())
        todo = todo.join(lost, "uid", "left_anti")
    rest = _folded(todo.select("image_id", *[F.col(f"box.{c}").alias(c) for c in _KEPT]), nms_threshold)
    return kept.select("image_id", *[f"box.{c}" for c in _KEPT]).unionByName(rest.drop("_r"))


def suppress_overlaps(raw: DataFrame, min_confidence: float = DEFAULT_MIN_CONFIDENCE,
                      nms_threshold: float = DEFAULT_NMS_THRESHOLD) -> DataFrame:
    """Greedy class-agnostic suppression; kept boxes, one row each, with
    their keep order in the image.

    Candidates (confidence > min_confidence) are taken in (confidence desc, pos asc)
    order, and one is kept unless a kept box overlaps it by more than
    ``nms_threshold``.  Images of up to ``FOLD_BOXES`` candidates are folded, one
    shuffle for all; the boxes of others are decided in rounds over many tasks
    (``_decide_crowded``) and ordered by a distributed running count.  Both give the
    same rows.  Below a threshold of 0 each image keeps its best box only."""
    cand = decode_boxes(raw).where(F.col("confidence") > min_confidence)
    checkpoint_dir(raw.sparkSession)
    out = lambda df: df.select("image_id", F.col("_r").cast("int").alias("keep_rank"), *_KEPT)
    if nms_threshold < 0:
        w = Window.partitionBy("image_id").orderBy(F.col("confidence").desc(), "pos")
        return out(cand.withColumn("_r", F.row_number().over(w) - 1).where("_r = 0"))
    crowded = (cand.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
               .where(F.col("_n") > FOLD_BOXES).select("image_id").checkpoint())
    if crowded.isEmpty():
        return out(_folded(cand, nms_threshold))
    same = cand["image_id"].eqNullSafe(crowded["image_id"])
    few = _folded(cand.join(crowded, same, "left_anti"), nms_threshold)
    many = _decide_crowded(cand.join(crowded, same, "left_semi"), nms_threshold)
    ranked = ordinal(many, [F.col("confidence").desc(), F.col("pos")], ["image_id"], out="_o")
    return out(few).unionByName(out(ranked.withColumn("_r", F.col("_o") - 1)))


def confidence_map(raw: DataFrame, labels: DataFrame,
                   min_confidence: float = DEFAULT_MIN_CONFIDENCE,
                   nms_threshold: float = DEFAULT_NMS_THRESHOLD) -> DataFrame:
    """Per image, label -> confidences of the kept boxes in kept
    order; every label of the class list is present (empty list if none).

    Kept boxes are grouped by class once and joined with the class list; the
    empty labels are filled in from the list as a scalar subquery.  The list is
    a property of the model and may have any length."""
    kept = suppress_overlaps(raw, min_confidence, nms_threshold)
    per_class = (kept.groupBy("image_id", "class_id")
                 .agg(F.sort_array(F.collect_list(F.struct("keep_rank", "confidence"))).alias("_c"))
                 .join(labels.select("class_id", "label"), "class_id"))
    found = per_class.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.transform("_c", lambda c: c["confidence"])))).alias("_found"))
    names = labels.agg(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "label"))),
                                   lambda l: l["label"])).scalar()
    none = F.array().cast("array<double>")
    images = raw.select("image_id").distinct().join(found, "image_id", "left").withColumn("_labels", names)
    entries = F.transform("_labels", lambda l: F.struct(
        l.alias("key"), F.coalesce(F.try_element_at("_found", l), none).alias("value")))
    return images.select("image_id", F.map_from_entries(entries).alias("detected"))


def caption_labels(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """P9 + J9: "<label>: <confidence to 4 places>" per kept box."""
    j = kept.join(labels, "class_id")
    return j.withColumn("caption", F.format_string("%s: %.4f", F.col("label"), F.col("confidence")))


def target_in_map(detected: Column, target: str, threshold: float = 0.5) -> Column:
    """F5 on a confidence document: any target confidence above threshold;
    a missing key or an empty/missing document is false."""
    return F.coalesce(F.exists(F.try_element_at(detected, F.lit(target)), lambda c: c > threshold),
                      F.lit(False))


# ---------------------------------------------------------------- D4 hook --
MODELS: dict[str, object] = {}  # of this Python worker, by the loader's digest


def worker_model(key: str, load_model: Callable[[], Callable]):
    """The worker's model for ``key``, loaded on first use."""
    if key not in MODELS:
        MODELS[key] = load_model()
    return MODELS[key]


def score_images(df: DataFrame, load_model: Callable[[], Callable], input_col: str,
                 keep_cols: list[str], out_schema: str) -> DataFrame:
    """Apply a user model to every row with ``mapInPandas``.

    ``load_model()`` is called once per Python worker; its model is kept in
    this module (which the worker imports) under the digest of the pickled
    loader, so equal loaders share it and others do not collide.  The model
    receives a pandas DataFrame batch (Arrow) with ``keep_cols`` and
    ``input_col`` and returns a pandas DataFrame matching ``out_schema``.
    """
    key = hashlib.sha256(cloudpickle.dumps(load_model)).hexdigest()
    ship_package(df.sparkSession)

    def run(batches: Iterator):
        from trendloom.operators import detect  # the worker's module, not a pickled copy of its globals
        model = detect.worker_model(key, load_model)
        for pdf in batches:
            yield model(pdf)

    return df.select(*keep_cols, input_col).mapInPandas(run, out_schema)


def linear_scorer(weights: list[float], input_col: str = "embedding",
                  id_cols: tuple[str, ...] = ("vec_id", "label")) -> Callable[[], Callable]:
    """A simple vectorised model for the hook: score = vec . weights."""
    def load():
        import numpy as np
        import pandas as pd
        w = np.asarray(weights, dtype="float64")

        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.stack(pdf[input_col].to_numpy()).astype("float64") if len(pdf) else np.zeros((0, len(w)))
            out = pdf[list(id_cols)].copy()
            out["score"] = (m @ w) if len(pdf) else pd.Series([], dtype="float64")
            return out
        return model
    return load



def embedding_detector(input_col: str = "embedding", key_cols: tuple[str, ...] = ("image_id", "pos"),
                       width: int = 640, height: int = 480) -> Callable[[], Callable]:
    """A stand-in detector for the hook: raw detector rows from a vector
    [cx, cy, w, h, objectness, scores...] around the image's centre."""
    def load():
        import numpy as np
        import pandas as pd

        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pdf[list(key_cols)].copy()
            out["w"], out["h"] = width, height
            vectors = [np.asarray(v, dtype="float64") for v in pdf[input_col]]
            out["vec"] = [np.concatenate([0.5 + v[:2], 0.2 + np.abs(v[2:4]), v[4:5], np.abs(v[5:])]) for v in vectors]
            return out
        return model
    return load


DETECTOR_SCHEMA = "w int, h int, vec array<double>"
