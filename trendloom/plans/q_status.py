"""Registered status / media / tracking queries (P1-P7, F1-F3, F6, F7, J1,
J4, J5, A10, W2, W4, T4, U1, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import status as st
from trendloom.operators import track
from trendloom.functions.plan import with_computed
from trendloom.functions.text import clean_tokens
from trendloom.plans.catalog import register
from trendloom.session import scratch_path
from trendloom.sources import derived
from trendloom.sources.tables import table

# fixed parameters of the registered queries: a tracking list with one- and
# two-word phrases, tags, handles, mixed case and a blank line.
TRACKING = ["#src3", "@Purchase", "thon thth", "Elle de", "lost words", "  ",
            "@view #src7", "ble", "@mail5", "#"]
ROW_LIMIT = 250
PHOTO_LIMIT = 500
PHOTOS_PER_USER = 3


def _statuses(spark, sf):
    return derived.nested_statuses(spark, sf)


def _phrases(spark):
    return spark.createDataFrame([(p,) for p in TRACKING], "phrase string").select(
        F.trim("phrase").alias("phrase")).where(F.col("phrase") != "")


def _flat_text(spark, sf):
    s = _statuses(spark, sf)
    return s.select(F.col("id_str").cast("long").alias("tweet_id"), st.full_text().alias("text"))


@register("full_text_flatten")
def q_full_text_flatten(spark, sf):
    return st.flatten_status(_statuses(spark, sf)).drop("quote_count", "reply_count",
                                                        "retweet_count", "favorite_count")


@register("drop_retweets")
def q_drop_retweets(spark, sf):
    return st.drop_retweets(_statuses(spark, sf)).select(F.col("id_str").alias("tweet_id"), "text")


@register("photo_urls")
def q_photo_urls(spark, sf):
    s = st.with_photo_slots(_statuses(spark, sf))
    return s.select(F.col("id_str").alias("tweet_id"),
                    F.size("photo_urls").cast("long").alias("n_photos"),
                    *[f"photo_{i}" for i in range(4)],
                    F.array_join("photo_urls", " ").alias("all_photos"))


@register("asset_paths")
def q_asset_paths(spark, sf):
    return st.asset_paths(_statuses(spark, sf))


@register("all_media_resolved")
def q_all_media_resolved(spark, sf):
    return st.all_media_resolved(_statuses(spark, sf), derived.assets(spark, sf)).select(
        F.col("id_str").alias("tweet_id"))


@register("has_asset")
def q_has_asset(spark, sf):
    s = st.with_photo_slots(_statuses(spark, sf))
    return st.has_asset(s, derived.assets(spark, sf), "photo_0", "media_url").select(
        F.col("id_str").alias("tweet_id"))


@register("has_asset_by_column")
def q_has_asset_by_column(spark, sf):
    s = st.with_photo_slots(_statuses(spark, sf))
    return st.has_asset(s, derived.assets(spark, sf), "photo_1", "media_url",
                        require_nonempty=False).select(F.col("id_str").alias("tweet_id"))


@register("distinct_media")
def q_distinct_media(spark, sf):
    return st.distinct_media(_statuses(spark, sf), PHOTOS_PER_USER)


@register("row_limit")
def q_row_limit(spark, sf):
    s = st.drop_retweets(_statuses(spark, sf)).withColumn("_id", F.col("id_str").cast("long"))
    return st.row_limit(s, ROW_LIMIT, ["created_at", "_id"]).select(
        F.col("id_str").alias("tweet_id"), "created_at")


@register("photo_limit")
def q_photo_limit(spark, sf):
    s = st.drop_retweets(_statuses(spark, sf)).withColumn("_id", F.col("id_str").cast("long"))
    return st.photo_limit(s, PHOTO_LIMIT, ["created_at", "_id"]).select(
        F.col("id_str").alias("tweet_id"), "photos_so_far")


@register("collected")
def q_collected(spark, sf):
    """The collection job in batch: F2 -> J5 -> P1..P7, 32 columns."""
    return st.collect_rows(_statuses(spark, sf), derived.assets(spark, sf))


@register("track_filter_small")
def q_track_filter_small(spark, sf):
    return track.match_phrases(_flat_text(spark, sf), _phrases(spark))


@register("track_filter_indexed")
def q_track_filter_indexed(spark, sf):
    """The tracking list written as a file and read back (S2), as a table."""
    path = scratch_path(spark, "tracking-list")
    _phrases(spark).select("phrase").write.text(path)
    return track.match_phrases(_flat_text(spark, sf), track.read_tracking(spark, path))


@register("track_filter")
def q_track_filter(spark, sf):
    return track.track_filter(_flat_text(spark, sf), _phrases(spark)).select("tweet_id", "n_phrases")


@register("track_filter_duplicates")
def q_track_filter_duplicates(spark, sf):
    """Each status delivered twice: each delivery of a match is kept."""
    s = _flat_text(spark, sf)
    return track.track_filter(s.unionByName(s), _phrases(spark)).select("tweet_id", "n_phrases")


def long_phrases(spark, sf):
    """Two two-word phrases for each document: its 2nd and 3rd, and its 4th
    and 5th token."""
    tok = with_computed(table(spark, sf, "documents").select("text"), "tok", clean_tokens("text"))
    pair = lambda i: F.concat_ws(" ", F.get("tok", F.lit(i)), F.get("tok", F.lit(i + 1)))
    return (tok.select(F.explode(F.array(pair(1), pair(3))).alias("phrase"))
            .where(F.col("phrase") != "").distinct())


@register("track_filter_long_list")
def q_track_filter_long_list(spark, sf):
    return track.track_filter(_flat_text(spark, sf), long_phrases(spark, sf)).select("tweet_id", "n_phrases")


@register("input_totals")
def q_input_totals(spark, sf):
    """The derived statuses hold each document's whole text once and each
    event once: characters, events and statuses read."""
    s = derived.nested_statuses(spark, sf)
    body = F.regexp_replace("text", "^RTX? ", "")
    return s.agg(F.count(F.lit(1)).alias("statuses"), F.sum(F.length(body)).alias("chars"),
                 F.sum((F.col("source") != "events").cast("long")).alias("documents"))


@register("union_runs")
def q_union_runs(spark, sf):
    """Two collection runs (before / from the median arrival time)
    appended into one table; a status re-delivered by both runs is kept
    once (by tweet id)."""
    s = st.collect_rows(_statuses(spark, sf), derived.assets(spark, sf)).select(
        "tweet_id", "user_id", "created_at", "image_file_0")
    cut = s.agg(F.percentile_approx("created_at", 0.5).alias("c")).scalar()
    run1 = s.where(F.col("created_at") <= cut)
    run2 = s.where(F.col("created_at") >= cut)
    return run1.unionByName(run2).dropDuplicates(["tweet_id"])
