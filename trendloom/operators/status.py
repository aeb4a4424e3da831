"""Status operators: flattening, media, retweets, asset joins, limits
(P1-P7, F2, F3, F6, F7, J4, J5, A10, W2, W4, T4).

Input is the nested status record of ``schemas.STATUS``.  Everything is a
projection (codegen) except the asset joins, the per-user cap and the
limits, which are joins/windows whose partitioning is described at each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.prefix import running_sum
from trendloom.schemas import COLLECTED_COLUMNS, N_SLOTS
from trendloom.session import written_once

IMAGE_DIR = "data/images/"
CONFIDENCE_DIR = "data/confidences/"


# ------------------------------------------------------------ expressions --
def full_text() -> Column:
    """The extended text when present, else the short text."""
    return F.coalesce(F.col("extended_tweet.full_text"), F.col("text"))


def photo_urls(media_field: str = "extended_entities") -> Column:
    """Media URLs of type photo, in order, duplicates kept; an
    absent media list gives an empty array."""
    media = F.coalesce(F.col(f"{media_field}.media"),
                       F.array().cast("array<struct<type:string,media_url:string>>"))
    return F.transform(F.filter(media, lambda m: m["type"] == "photo"), lambda m: m["media_url"])


def is_retweet(text_col: str = "text") -> Column:
    """the short text starts with 'RT' (case-sensitive, bare prefix)."""
    return F.col(text_col).startswith("RT")


def asset_id(tweet_id: Column, slot: Column, url: Column) -> Column:
    """Deterministic id of one landed image (re-runs give the same id)."""
    return F.sha2(F.concat_ws("/", tweet_id.cast("string"), slot.cast("string"), url), 256)


def _slot_paths(ids: Column) -> dict[str, Column]:
    out = {}
    for i in range(N_SLOTS):
        aid = F.get(ids, i)
        out[f"image_file_{i}"] = F.concat(F.lit(IMAGE_DIR), aid, F.lit(".jpg"))
        out[f"marked_up_image_file_{i}"] = F.concat(F.lit(IMAGE_DIR), aid, F.lit("_marked.jpg"))
        out[f"csv_to_json_file_path_{i}"] = F.concat(F.lit(CONFIDENCE_DIR), aid, F.lit(".json"))
    return out


# -------------------------------------------------------------- operators --
def drop_retweets(statuses: DataFrame, text_col: str = "text") -> DataFrame:
    """F2.  A null text is not a retweet."""
    return statuses.where(~F.coalesce(is_retweet(text_col), F.lit(False)))


def flatten_status(statuses: DataFrame) -> DataFrame:
    """Nested status -> flat columns (no media)."""
    coords = F.col("coordinates.coordinates")
    return statuses.select(
        F.col("user.id_str").alias("user_id"),
        F.col("id_str").alias("tweet_id"),
        full_text().alias("text"),
        F.col("created_at"),
        F.col("source"),
        F.col("truncated"),
        F.col("in_reply_to_status_id_str").alias("in_reply_to_status_id"),
        F.col("in_reply_to_user_id_str").alias("in_reply_to_user_id"),
        F.col("in_reply_to_screen_name"),
        F.get(coords, 0).alias("longitude"),
        F.get(coords, 1).alias("latitude"),
        F.col("place.full_name").alias("place_full_name"),
        F.col("place.place_type").alias("place_type"),
        F.col("place.id").alias("place_id"),
        F.col("place.url").alias("place_url"),
        F.col("quote_count"), F.col("reply_count"), F.col("retweet_count"),
        F.col("favorite_count"),
        F.col("lang"),
        F.col("user.protected").alias("protected"),
    )


def with_photo_slots(statuses: DataFrame) -> DataFrame:
    """``photo_urls`` (full list) and ``photo_0..3`` (first four)."""
    s = statuses.withColumn("photo_urls", photo_urls())
    return s.select("*", *[F.get(F.col("photo_urls"), i).alias(f"photo_{i}") for i in range(N_SLOTS)])


def asset_paths(statuses: DataFrame) -> DataFrame:
    """P7 in long form: one row per photo slot (first four photos) with the
    relative image, marked-image and confidence-document paths."""
    s = statuses.select(F.col("id_str").alias("tweet_id"),
                        F.posexplode(F.slice(photo_urls(), 1, N_SLOTS)).alias("slot", "media_url"))
    aid = asset_id(F.col("tweet_id"), F.col("slot"), F.col("media_url"))
    return s.select(
        "tweet_id", "slot", "media_url",
        F.concat(F.lit(IMAGE_DIR), aid, F.lit(".jpg")).alias("image_file"),
        F.concat(F.lit(IMAGE_DIR), aid, F.lit("_marked.jpg")).alias("marked_up_image_file"),
        F.concat(F.lit(CONFIDENCE_DIR), aid, F.lit(".json")).alias("csv_to_json_file_path"),
    )


def all_media_resolved(statuses: DataFrame, assets: DataFrame, url_col: str = "media_url",
                       id_col: str = "id_str", write_missing: bool = False) -> DataFrame:
    """Drop a status when any of its photos has no landed asset;
    statuses without photos are kept.

    Photos are exploded and anti-joined with the asset listing (shuffle on
    the URL; a hot URL is split by AQE's skew-join handling, the asset side
    is never forced to broadcast because a listing grows with the data).
    The ids with a missing photo are then anti-joined away.  With ``write_missing``
    they are written once before: their size is known when the join is planned, so a few
    are broadcast and no text is shuffled.
    """
    urls = statuses.select(F.col(id_col).alias("_sid"),
                           F.explode(photo_urls()).alias("_url"))
    listing = assets.select(F.col(url_col).alias("_url"))
    missing = urls.join(listing, "_url", "left_anti").select("_sid").distinct()
    if write_missing:
        missing = written_once(missing, "missing-photos")
    return statuses.join(missing, statuses[id_col] == missing["_sid"], "left_anti")


def has_asset(rows: DataFrame, assets: DataFrame, column: str = "image_file_0",
              asset_col: str = "path", require_nonempty: bool = True) -> DataFrame:
    """Keep rows whose ``column`` names a landed asset.

    ``require_nonempty=False`` reproduces the older cleaner, which tested
    the directory itself for an empty path and so kept such rows.  Rows with an
    empty path never enter the join, where they would all meet on one key.
    """
    c = F.col(column)
    empty = c.isNull() | (c == "")
    listing = assets.select(F.col(asset_col).alias("_p"))
    found = rows.where(~empty).join(listing, c == F.col("_p"), "left_semi")
    return found if require_nonempty else found.unionByName(rows.where(empty))


def cap_photos_per_user(statuses: DataFrame, limit: int, user_col="user.id_str",
                        id_col=None, media_field: str = "entities") -> DataFrame:
    """A user's photo occurrences newest status first (id desc, then
    position), at most ``limit`` of them (-1 = all).  Duplicates count.

    ``row_number() <= limit`` per user plans a partial WindowGroupLimit
    before the shuffle, so each map task sends at most ``limit`` rows per
    user: a user with a third of all statuses costs ``limit x tasks`` rows.
    """
    user = F.col(user_col) if isinstance(user_col, str) else user_col
    sid = F.col("id_str").cast("long") if id_col is None else (
        F.col(id_col) if isinstance(id_col, str) else id_col)
    occ = statuses.select(user.alias("user_id"), sid.alias("_id"),
                          F.posexplode(photo_urls(media_field)).alias("_pos", "media_url"))
    if limit == -1:
        return occ
    w = Window.partitionBy("user_id").orderBy(F.col("_id").desc(), F.col("_pos").asc())
    return occ.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def distinct_media(statuses: DataFrame, limit: int = -1, user_col="user.id_str",
                   id_col=None, media_field: str = "entities") -> DataFrame:
    """The set of photo URLs per user after the occurrence cap."""
    return (cap_photos_per_user(statuses, limit, user_col, id_col, media_field)
            .select("user_id", "media_url").distinct())


def row_limit(statuses: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """T4: the first ``limit`` statuses in arrival order: TakeOrderedAndProject
    (per-partition top-n, merge of n rows per partition)."""
    order = order or ["created_at", "id_str"]
    return statuses.orderBy(*order).limit(limit)


def photo_limit(statuses: DataFrame, limit: int, order: list[str] | None = None,
                count_col: Column | None = None) -> DataFrame:
    """Statuses in arrival order while the running photo count (this
    status included) stays within ``limit``.

    The two-phase prefix sum runs on (order key, photos) only; the keys that
    fit are joined back to the statuses, so no text is dealt by range or
    written.  Deliveries of one status share a key and are counted one after
    the other."""
    order = order or ["created_at", "id_str"]
    n = count_col if count_col is not None else F.size(photo_urls()).cast("long")
    keys = (statuses.select(*order, F.coalesce(n, F.lit(0)).cast("long").alias("_n"))
            .groupBy(*order).agg(F.max("_n").alias("_n"), F.sum("_n").alias("_all")))
    run = running_sum(keys, F.col("_all"), order, out="_after")
    kept = (run.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], "_n",
                       (F.col("_after") - F.col("_all")).alias("_before"))
            .where(F.col("_before") + F.col("_n") <= limit))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order)]
    copy = F.row_number().over(Window.partitionBy(*order).orderBy("_n"))
    rows = statuses.join(kept, same).withColumn("photos_so_far", F.col("_before") + copy * F.col("_n"))
    return rows.where(F.col("photos_so_far") <= limit).drop("_n", "_before", *[f"_k{i}" for i in range(len(order))])


def collect_rows(statuses: DataFrame, assets: DataFrame | None = None,
                 drop_rts: bool = True, photos_col: str | None = None) -> DataFrame:
    """The collection job's batch body: F2 -> J5 -> P1..P7 -> the flat
    32-column collected table (absent slots are null; the CSV sink writes
    them as empty strings).  ``photos_col`` adds the number of all photos of
    the status, which the photo limit counts."""
    s = drop_retweets(statuses) if drop_rts else statuses
    if assets is not None:
        s = all_media_resolved(s, assets, write_missing=True)
    s = s.withColumn("_urls", F.slice(photo_urls(), 1, N_SLOTS))
    ids = F.transform(F.col("_urls"), lambda u, i: asset_id(F.col("id_str"), i, u))
    s = s.withColumn("_ids", ids)
    paths = _slot_paths(F.col("_ids"))
    coords = F.col("coordinates.coordinates")
    exprs = {
        "user_id": F.col("user.id_str"), "tweet_id": F.col("id_str"), "text": full_text(),
        "created_at": F.col("created_at"), "source": F.col("source"),
        "truncated": F.col("truncated"),
        "in_reply_to_status_id": F.col("in_reply_to_status_id_str"),
        "in_reply_to_user_id": F.col("in_reply_to_user_id_str"),
        "in_reply_to_screen_name": F.col("in_reply_to_screen_name"),
        "longitude": F.get(coords, 0), "latitude": F.get(coords, 1),
        "place_full_name": F.col("place.full_name"), "place_type": F.col("place.place_type"),
        "place_id": F.col("place.id"), "place_url": F.col("place.url"),
        "quote_count": F.col("quote_count"), "reply_count": F.col("reply_count"),
        "retweet_count": F.col("retweet_count"), "favorite_count": F.col("favorite_count"),
        "lang": F.col("lang"), **paths,
    }
    more = [F.size(photo_urls()).cast("long").alias(photos_col)] if photos_col else []
    return s.select(*[exprs[c].alias(c) for c in COLLECTED_COLUMNS], *more)
