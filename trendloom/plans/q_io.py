"""Registered sink/source round trips and streaming queries (K1-K6, S1-S7,
ST1-ST3, ST6, ST7).  Each writes through the sink into a fresh folder under
the session's shared checkpoint folder, reads back with the source, and
returns what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import detect, pages, track, status as st
from trendloom.operators.graph import user_images
from trendloom.operators.pages import page_caption, page_meta
from trendloom.plans import jobs, q_detect, q_status, q_terms
from trendloom.plans.catalog import register
from trendloom.session import scratch_path, written_once
from trendloom.sources import derived, files, sinks, variants
from trendloom.sources.tables import table
from trendloom.streaming.collect import (
    read_collected_sink, read_ledger, read_progress, run_collect_stream,
)
from trendloom.streaming.first_rows import read_first_rows, run_first_rows
from trendloom.streaming.listing import AssetListing, follow_files, landed_once

STREAM_LIMIT = 300
PHOTO_LIMIT = 400


def _collected(spark, sf):
    return st.collect_rows(derived.nested_statuses(spark, sf), derived.assets(spark, sf))


@register("csv_round_trip")
def q_csv_round_trip(spark, sf):
    path = scratch_path(spark, "collected-csv")
    sinks.write_collected(_collected(spark, sf), path, "csv", "append")
    return files.read_collected(spark, path)


@register("write_tracking")
def q_write_tracking(spark, sf):
    path = scratch_path(spark, "tracking")
    sinks.write_tracking(q_terms.q_trending_terms(spark, sf), path)
    from trendloom.operators.track import read_tracking
    return read_tracking(spark, path).select(F.col("phrase").alias("term"))


def _landed_paths(spark, sf) -> DataFrame:
    """Relative image paths of the photos whose asset landed."""
    a = st.asset_paths(derived.nested_statuses(spark, sf))
    return a.join(derived.assets(spark, sf), "media_url", "left_semi").select(
        F.col("image_file").alias("path"))


@register("rewrite_table")
def q_rewrite_table(spark, sf):
    path = scratch_path(spark, "collected-table")
    sinks.write_collected(_collected(spark, sf), path, "parquet", "overwrite")
    landed = _landed_paths(spark, sf)

    def read(s, p):
        return s.read.parquet(p)

    def clean(df):
        return st.has_asset(df, landed, "image_file_0", "path")

    def write(df, p):
        df.write.mode("overwrite").parquet(p)

    sinks.rewrite_table(spark, path, read, clean, write)
    return read(spark, sinks.current_version(spark, path)).select("tweet_id", "image_file_0")


@register("user_partitions")
def q_user_partitions(spark, sf):
    path = scratch_path(spark, "users")
    # read four times below, so derived once
    s = written_once(_arriving(spark, sf).select("id_str", "user", "entities"), "timelines")
    users = (s.select(F.col("user.id_str").cast("long").alias("user_id"),
                      F.col("user.screen_name").alias("screen_name"),
                      F.col("user.protected").alias("protected"))
             .dropDuplicates(["user_id"]))
    imgs = user_images(s, 3)
    rec = written_once(users.join(imgs, "user_id"), "user-records")  # both runs are given the same
    sinks.write_user_partitions(spark, rec, path)
    sinks.write_user_partitions(spark, rec, path)  # second run: every user exists, skipped
    return files.read_user_partitions(spark, path, "user_id long, screen_name string, protected boolean, n_images long")


@register("posts_sink")
def q_posts_sink(spark, sf):
    path = scratch_path(spark, "posts")
    p = derived.post_pages(spark, sf)
    link = page_meta("html", "og:image")
    posts = p.where(link.isNotNull()).select(
        F.regexp_extract("url", r"//([^/:]+)", 1).alias("query_dir"),
        F.concat(F.lit("./data/"), F.regexp_extract("url", r"//([^/:]+)", 1), F.lit("/images/"),
                 F.sha2(link, 256), F.lit(".jpg")).alias("imagefile"),
        page_caption("html").alias("caption"))
    sinks.write_posts(posts, path)
    back = (spark.read.schema("imagefile string, caption string, query_dir string")
            .option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    return back.select("query_dir", "imagefile", F.coalesce("caption", F.lit("")).alias("caption"))


@register("confidence_json")
def q_confidence_json(spark, sf):
    path = scratch_path(spark, "confidences")
    m = detect.confidence_map(derived.detections(spark, sf), derived.class_labels(spark),
                              q_detect.MIN_CONFIDENCE, q_detect.NMS_THRESHOLD)
    sinks.write_confidences(m, path)
    back = files.read_confidence_lines(spark, path)
    return back.select("image_id", detect.target_in_map(F.col("detected"), "c07", 0.3).alias("has_target"),
                       F.size(F.map_keys("detected")).cast("long").alias("n_labels"))


# ------------------------------------------------------- sources by file --
@register("read_labels")
def q_read_labels(spark, sf):
    """The event types, one a line in order, as a class list."""
    path = scratch_path(spark, "labels")
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("value")).distinct()
    # one line for each class: a list as long as the model's class list
    kinds.agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("value")).write.text(path)
    return detect.read_labels(spark, f"{path}/part-*")


SHELVES = 64  # folders that the files of one source are dealt to


def _land_files(documents, path: str) -> None:
    """One file for each (source, shelf) folder, with the texts of its documents."""
    (documents.select("source", F.pmod("doc_id", F.lit(SHELVES)).alias("shelf"), "text")
     .repartition("source", "shelf").write.mode("append").partitionBy("source", "shelf").text(path, lineSep="\u0001"))


def _drifting(spark, sf) -> str:
    """Statuses as JSON lines of changing shape: counts as text in every third, two
    fields that the record type lacks, a place that is no object where there was none,
    and a line that is cut off beside every fiftieth."""
    path = scratch_path(spark, "drifting")
    s = _arriving(spark, sf)
    i = F.col("id_str").cast("long")
    whole = F.to_json(F.struct(*s.columns), sinks.JSON_OPTIONS)
    line = F.when(i % 3 == 0, F.regexp_replace(whole, '"(favorite_count|retweet_count)":(\\d+)', '"$1":"$2"')).otherwise(whole)
    more = lambda text: F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(text))
    t = s.select(i.alias("i"), line.alias("line"), F.col("place").isNull().alias("nowhere"))
    t = t.withColumn("line", F.when(F.col("i") % 4 == 1, more(',"edit_history":[{"at":1},2]}')).otherwise(F.col("line")))
    t = t.withColumn("line", F.when(F.col("i") % 5 == 2, more(',"note":null}')).otherwise(F.col("line")))
    t = t.withColumn("line", F.when(F.col("nowhere"), more(',"place":"nowhere"}')).otherwise(F.col("line")))
    cut = F.when(F.col("i") % 50 == 7, F.array("line", F.lit('{"id_str": "cut'))).otherwise(F.array("line"))
    t.select(F.explode(cut).alias("value")).write.text(path, compression="gzip")
    return path


@register("drifting_records")
def q_drifting_records(spark, sf):
    """S1/P1 over records whose shape drifts: the same 32 columns as from clean ones."""
    records = variants.read_records(spark, _drifting(spark, sf))
    return st.collect_rows(variants.typed_statuses(records), derived.assets(spark, sf))


@register("unknown_fields")
def q_unknown_fields(spark, sf):
    """The fields that the record type does not know, and the lines that are no record."""
    records = variants.read_records(spark, _drifting(spark, sf))
    broken = records.where(F.col(files.CORRUPT).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    return variants.unknown_fields(records).unionByName(broken.select(F.lit("(broken)").alias("field"), "n"))


@register("list_assets")
def q_list_assets(spark, sf):
    """Documents landed in one file for each source and shelf; the listing gives
    every file's folder and bytes."""
    path = scratch_path(spark, "landed")
    _land_files(table(spark, sf, "documents"), path)
    listing = files.list_assets(spark, path, path, "part-*")
    return listing.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), "length")


@register("listing_stream")
def q_listing_stream(spark, sf):
    """S7/ST1: the files land in two waves; the listing follows them over a restart and
    holds every file once."""
    path, ckpt = scratch_path(spark, "landed"), scratch_path(spark, "listing-ckpt")
    docs = table(spark, sf, "documents")
    listing = AssetListing(spark)
    first = F.pmod("doc_id", F.lit(SHELVES)) < SHELVES // 3
    for wave in (docs.where(first), docs.where(~first)):
        _land_files(wave, path)
        follow_files(listing, path, ckpt, "part-*")
    return listing.table().select(F.regexp_extract("asset", "^(.*)/", 1).alias("folder"), "length")


@register("read_pages")
def q_read_pages(spark, sf):
    """Landed pages written as a table and read back, with their links."""
    path = scratch_path(spark, "pages")
    derived.post_pages(spark, sf).write.parquet(path)
    return files.read_pages(spark, path).select(
        "page_id", "url", pages.page_meta("html", "og:image").alias("og_image"),
        F.length("html").cast("long").alias("n_chars"))


@register("baseline_file")
def q_baseline_file(spark, sf):
    """The baseline table written as CSV (term, count, freq) with a
    stale line for every term before its current one; reading keeps the
    last line of each term (files in name order: a union writes its first side
    first)."""
    path = scratch_path(spark, "baseline-csv")
    base = q_terms._baseline(spark, sf)
    stale = base.select("term", F.lit("0").alias("count"),
                        (F.col("freq") * 2).cast("string").alias("freq"))
    fresh = base.select("term", F.lit("1").alias("count"), F.col("freq").cast("string").alias("freq"))
    stale.unionByName(fresh).write.mode("overwrite").option("header", True).csv(path)
    return files.read_baseline(spark, path)


# ----------------------------------------------------------------- jobs --
def _land_json(spark, sf) -> str:
    path = scratch_path(spark, "statuses-json")
    # a status says its text twice, so compressed lines are a fraction; the files are as many as the shuffle's parts
    sinks.write_statuses(_arriving(spark, sf), path, compression="gzip")
    return path


def _tracking_file(spark) -> str:
    path = scratch_path(spark, "tracking-file")
    q_status._phrases(spark).select("phrase").write.text(path)
    return path


@register("collect_job")
def q_collect_job(spark, sf):
    """§2.16 collect: landed JSON and a tracking file to the collected table,
    the first rows up to a limit."""
    out = scratch_path(spark, "collect-job")
    jobs.collect_batch_job(spark, _land_json(spark, sf), out, _tracking_file(spark), derived.assets(spark, sf),
                           limit=STREAM_LIMIT)
    return files.read_collected(spark, out).select("tweet_id", "created_at", "text")


@register("collect_job_photos")
def q_collect_job_photos(spark, sf):
    """§2.16 collect with ``photos_as_limit``."""
    out = scratch_path(spark, "collect-job")
    jobs.collect_batch_job(spark, _land_json(spark, sf), out, None, derived.assets(spark, sf),
                           limit=PHOTO_LIMIT, photos_as_limit=True)
    return files.read_collected(spark, out).select("tweet_id", "created_at")


@register("posts_job")
def q_posts_job(spark, sf):
    """§2.16 posts: the first two posts of each crawl query."""
    out = scratch_path(spark, "posts-job")
    landed = derived.post_pages(spark, sf).withColumn("query_dir", F.regexp_extract("url", r"//([^/:]+)", 1))
    jobs.posts_job(landed, out, 2)
    back = (spark.read.schema("imagefile string, caption string, query_dir string")
            .option("header", True).option("multiLine", True).option("escape", '"').csv(out))
    return back.select("query_dir", "imagefile", F.coalesce("caption", F.lit("")).alias("caption"))


DETECT_TARGET = "c12"


@register("detect_to_target")
def q_detect_to_target(spark, sf):
    """Collect + detect, then the trend terms of what shows the target:
    D4 -> D1 -> D2 -> K2 -> S4 -> J3 -> trending terms.  The image in a status'
    first slot holds two proposals (embeddings 2i and 2i + 1 for status i)."""
    out, docs, top = (scratch_path(spark, n) for n in ("collect-detect", "confidence-docs", "tracking"))
    statuses = derived.nested_statuses(spark, sf)
    first = st.asset_paths(statuses).where("slot = 0").select(F.col("tweet_id").cast("long").alias("_t"), "image_file")
    emb = table(spark, sf, "embeddings").select(F.expr("vec_id div 2").alias("_t"), F.col("vec_id").alias("pos"), "embedding")
    images = first.join(emb, "_t").select("image_file", "pos", "embedding")
    jobs.collect_detect_job(spark, _land_json(spark, sf), out, docs, images, detect.embedding_detector(),
                            derived.class_labels(spark), q_detect.MIN_CONFIDENCE, q_detect.NMS_THRESHOLD,
                            assets=derived.assets(spark, sf))
    return jobs.trending_files_job(spark, out, docs, None, q_terms._baseline(spark, sf), top, DETECT_TARGET,
                                   q_detect.MIN_CONFIDENCE, 400, 1).select("rank", "term", "n", "rel")


# ------------------------------------------------------------ streaming --
def _arriving(spark, sf) -> DataFrame:
    """The records of ``derived.nested_statuses`` from one shuffle of each table."""
    return derived.statuses_of(spark, sf, derived.status_sources(spark, sf))


def land_statuses(spark: SparkSession, statuses: DataFrame, dest: str, n_files: int | None = None, records=None) -> None:
    """Land statuses as JSON-lines files in arrival order: one distributed
    write, dealt by range of (created_at, id), whose file names follow that
    order.  The files are then moved into ``dest`` and stamped one after the other,
    which touches their directory entries only; the file stream takes files by
    their time.  The number of files follows the statuses' size (AQE merges small
    neighbouring ranges), so a small landing is not many micro-batches, and is at most the
    session's shuffle partitions.  Such files are compressed: a status says its text twice.  A given number of
    files may make large ones, so these stay in plain text, which tasks can share.  With ``records`` the
    statuses are ``derived.status_sources`` and become records after they are dealt."""
    staging = scratch_path(spark, "landing")
    dealt = (statuses.withColumn("_id", F.col("tweet_id") if records else F.col("id_str").cast("long"))
             .repartitionByRange(*([n_files] if n_files else []), "created_at", "_id").sortWithinPartitions("created_at", "_id").drop("_id"))
    ((records(dealt) if records else dealt)
     .write.options(**sinks.JSON_OPTIONS, compression="none" if n_files else "gzip").json(staging))
    _move_in_order(spark, staging, dest)


def _land_in_order(spark, sf, dest: str, n_files: int | None = None) -> None:
    """``land_statuses`` of all statuses, whose texts are dealt once and not as records."""
    land_statuses(spark, derived.status_sources(spark, sf), dest, n_files, lambda rows: derived.statuses_of(spark, sf, rows))


def _move_in_order(spark: SparkSession, staging: str, dest: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(dest)
    fs = src.getFileSystem(conf)
    fs.mkdirs(dst)
    # a half without statuses has no folder
    names = sorted(s.getPath().getName() for s in fs.listStatus(src) if s.getPath().getName().startswith("part-")) if fs.exists(src) else []
    earlier = [s.getModificationTime() for s in fs.listStatus(dst)]
    began = max([jvm.java.lang.System.currentTimeMillis(), *[t + 1 for t in earlier]])
    landing = uuid.uuid4().hex
    for i, name in enumerate(names):
        path = jvm.org.apache.hadoop.fs.Path(f"{staging.rstrip('/')}/{name}")
        fs.setTimes(path, began + i, -1)
        fs.rename(path, jvm.org.apache.hadoop.fs.Path(f"{dest.rstrip('/')}/statuses-{landing}-{i:05d}.json{'.gz' * name.endswith('.gz')}"))


def _stream_dirs(spark):
    return scratch_path(spark, "stream-src"), scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")


def _streamed(spark, sf, **options) -> str:
    """Land the statuses, run the collection stream over them, return the sink.  A limit takes the
    first rows, so then the files follow the order of arrival; without one each file holds any time,
    and no text is shuffled for the landing."""
    src, sink, ckpt = _stream_dirs(spark)
    if options.get("limit") is None:
        _move_in_order(spark, _land_json(spark, sf), src)
    else:
        _land_in_order(spark, sf, src)
    run_collect_stream(spark, src, sink, ckpt, assets=derived.assets(spark, sf), **options)
    return sink


@register("collect_stream")
def q_collect_stream(spark, sf):
    """ST1 with a tracking list."""
    sink = _streamed(spark, sf, phrases=q_status._phrases(spark), max_files_per_trigger=4)
    return read_collected_sink(spark, sink)


@register("collect_stream_all")
def q_collect_stream_all(spark, sf):
    """ST1 without a tracking list: every status."""
    return read_collected_sink(spark, _streamed(spark, sf, max_files_per_trigger=4))


@register("collect_stream_long_list")
def q_collect_stream_long_list(spark, sf):
    """ST1 with two phrases for each document."""
    path = scratch_path(spark, "long-list")
    q_status.long_phrases(spark, sf).write.text(path)
    sink = _streamed(spark, sf, phrases=track.read_tracking(spark, path), max_files_per_trigger=8)
    return read_collected_sink(spark, sink).select("tweet_id", "created_at")


@register("stop_at_limit")
def q_stop_at_limit(spark, sf):
    sink = _streamed(spark, sf, limit=STREAM_LIMIT, max_files_per_trigger=1)
    return read_collected_sink(spark, sink).select("tweet_id", "created_at")


@register("first_rows_any_order")
def q_first_rows_any_order(spark, sf):
    """ST2 in event time: statuses land in files by a hash of their id, so every file
    holds every time; the rows are those of ``stop_at_limit`` all the same."""
    src, sink, ckpt = _stream_dirs(spark)
    staging = scratch_path(spark, "landing")
    (_arriving(spark, sf).repartition(8, F.xxhash64("id_str"))
     .write.options(**sinks.JSON_OPTIONS).json(staging))
    _move_in_order(spark, staging, src)
    run_first_rows(spark, src, sink, ckpt, STREAM_LIMIT, derived.assets(spark, sf), max_files_per_trigger=2)
    return read_first_rows(spark, sink).select("tweet_id", "created_at")


@register("photo_limit_stream")
def q_photo_limit_stream(spark, sf):
    """The photo limit over the whole stream, whatever the batches."""
    sink = _streamed(spark, sf, limit=PHOTO_LIMIT, photos_as_limit=True, max_files_per_trigger=1)
    return read_collected_sink(spark, sink).select("tweet_id", "created_at")


def _halves(spark, sf):
    s = _arriving(spark, sf)
    cut = s.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    return s.where(F.col("created_at") <= F.lit(cut)), s.where(F.col("created_at") > F.lit(cut))


def _landed_halves(spark, sf, again: bool = False) -> list[str]:
    """Both halves of the statuses by time as JSON lines, one folder for each; the statuses
    are derived and their texts shuffled once for both.  With ``again`` the later folder has the
    statuses of the first half too."""
    cut = _arriving(spark, sf).agg(F.percentile_approx("created_at", 0.5)).first()[0]
    staging = scratch_path(spark, "landing")
    later = F.col("created_at") > F.lit(cut)
    if again:
        later = F.explode(F.when(later, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True))))
    # sorted while narrow: a writer has one folder open at a time
    rows = derived.status_sources(spark, sf).withColumn("_later", later).sortWithinPartitions("_later")
    (derived.statuses_of(spark, sf, rows, "_later").write.partitionBy("_later")
     .options(**sinks.JSON_OPTIONS, compression="gzip").json(staging))
    return [f"{staging}/_later={later}" for later in ("false", "true")]


@register("resume")
def q_resume(spark, sf):
    """ST3: the stream stops after the first half of the statuses; the second
    half lands; a restart on the same checkpoint continues without
    re-emitting or losing rows."""
    src, sink, ckpt = _stream_dirs(spark)
    assets = landed_once(spark, derived.assets(spark, sf))
    for half in _landed_halves(spark, sf):
        _move_in_order(spark, half, src)
        run_collect_stream(spark, src, sink, ckpt, assets=assets, max_files_per_trigger=4)
    assets.drop()
    return read_collected_sink(spark, sink).select("tweet_id", "user_id", "image_file_0")


@register("redelivery")
def q_redelivery(spark, sf):
    """ST3: after a restart the second half arrives together with the whole first
    half again; each status is collected once."""
    src, sink, ckpt = _stream_dirs(spark)
    assets = landed_once(spark, derived.assets(spark, sf))
    for part in _landed_halves(spark, sf, again=True):
        _move_in_order(spark, part, src)
        run_collect_stream(spark, src, sink, ckpt, assets=assets, max_files_per_trigger=4, redelivery="1 day")
    assets.drop()
    return read_collected_sink(spark, sink).select("tweet_id", "user_id", "image_file_0")


@register("two_runs_one_sink")
def q_two_runs_one_sink(spark, sf):
    """Two runs, each with its own source and checkpoint, append to one sink."""
    sink = scratch_path(spark, "stream-sink")
    assets = landed_once(spark, derived.assets(spark, sf))
    for half in _landed_halves(spark, sf):
        src, _, ckpt = _stream_dirs(spark)
        _move_in_order(spark, half, src)
        run_collect_stream(spark, src, sink, ckpt, assets=assets, max_files_per_trigger=8)
    assets.drop()
    return read_collected_sink(spark, sink).select("tweet_id", "user_id")


@register("stream_progress")
def q_stream_progress(spark, sf):
    """ST4/A12: statuses and photos read by the collection stream, from its
    ledger."""
    sink = _streamed(spark, sf, max_files_per_trigger=4, name="collect_progress")
    return read_progress(spark, sink).select("statuses", "photos")


@register("ingest_rate")
def q_ingest_rate(spark, sf):
    """ST6: twelve files at three a trigger make four batches and lose nothing."""
    src, sink, ckpt = _stream_dirs(spark)
    _land_in_order(spark, sf, src, 12)
    run_collect_stream(spark, src, sink, ckpt, max_files_per_trigger=3)
    return read_ledger(spark, sink).agg(F.count(F.lit(1)).alias("batches"), F.sum("statuses").alias("statuses"))


@register("bad_records")
def q_bad_records(spark, sf):
    """ST5: every fiftieth line is cut off; the rejects keep these lines and the
    collected table the others."""
    src, sink, ckpt = _stream_dirs(spark)
    rejects, staging = scratch_path(spark, "rejects"), scratch_path(spark, "broken")
    s = _arriving(spark, sf)
    line = F.when(F.col("id_str").cast("long") % 50 == 7, F.concat(F.lit('{"id_str": "'), "id_str", F.lit('", "text": ')))
    s.select(F.coalesce(line, F.to_json(F.struct(*s.columns), sinks.JSON_OPTIONS)).alias("value")).write.text(staging, compression="gzip")
    _move_in_order(spark, staging, src)
    run_collect_stream(spark, src, sink, ckpt, rejects=rejects, max_files_per_trigger=8)
    bad = spark.read.schema(f"{files.CORRUPT} string").parquet(rejects).select(
        F.lit("rejected").alias("kind"), F.col(files.CORRUPT).alias("value"))
    good = read_collected_sink(spark, sink).select(F.lit("collected").alias("kind"), F.col("tweet_id").alias("value"))
    return bad.unionByName(good)
