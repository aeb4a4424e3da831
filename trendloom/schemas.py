"""Explicit schemas (never inferred)."""

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_D = T.DoubleType()
_B = T.BooleanType()

MEDIA_ITEM = T.StructType([T.StructField("type", _S), T.StructField("media_url", _S)])
MEDIA_LIST = T.StructType([T.StructField("media", T.ArrayType(MEDIA_ITEM))])

# Nested status record (input of the collection job).  created_at is
# timestamp_ntz: the wall-clock value as landed, no session time-zone shift.
STATUS = T.StructType([
    T.StructField("id_str", _S),
    T.StructField("text", _S),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("source", _S),
    T.StructField("truncated", _B),
    T.StructField("lang", _S),
    T.StructField("user", T.StructType([
        T.StructField("id_str", _S),
        T.StructField("screen_name", _S),
        T.StructField("protected", _B),
    ])),
    T.StructField("in_reply_to_status_id_str", _S),
    T.StructField("in_reply_to_user_id_str", _S),
    T.StructField("in_reply_to_screen_name", _S),
    T.StructField("coordinates", T.StructType([
        T.StructField("type", _S),
        T.StructField("coordinates", T.ArrayType(_D)),
    ])),
    T.StructField("place", T.StructType([
        T.StructField("id", _S),
        T.StructField("full_name", _S),
        T.StructField("place_type", _S),
        T.StructField("url", _S),
    ])),
    T.StructField("extended_tweet", T.StructType([T.StructField("full_text", _S)])),
    T.StructField("extended_entities", MEDIA_LIST),
    T.StructField("entities", MEDIA_LIST),
    T.StructField("quote_count", _L),
    T.StructField("reply_count", _L),
    T.StructField("retweet_count", _L),
    T.StructField("favorite_count", _L),
])

N_SLOTS = 4

# The flat collected table, columns named and ordered as the collected files have them.
COLLECTED_COLUMNS = (
    ["user_id", "tweet_id", "text"]
    + [f"image_file_{i}" for i in range(N_SLOTS)]
    + [f"marked_up_image_file_{i}" for i in range(N_SLOTS)]
    + [f"csv_to_json_file_path_{i}" for i in range(N_SLOTS)]
    + ["created_at", "source", "truncated", "in_reply_to_status_id", "in_reply_to_user_id",
       "in_reply_to_screen_name", "longitude", "latitude", "place_full_name", "place_type",
       "place_id", "place_url", "quote_count", "reply_count", "retweet_count",
       "favorite_count", "lang"]
)

_COLLECTED_TYPES = {
    "created_at": T.TimestampNTZType(), "truncated": _B, "longitude": _D, "latitude": _D,
    "quote_count": _L, "reply_count": _L, "retweet_count": _L, "favorite_count": _L,
}

COLLECTED = T.StructType([T.StructField(c, _COLLECTED_TYPES.get(c, _S))
                          for c in COLLECTED_COLUMNS])

# One JSON document per image: label -> confidences of the kept boxes.
CONFIDENCE_DOC = T.MapType(_S, T.ArrayType(_D))

BASELINE_CSV = T.StructType([
    T.StructField("term", _S), T.StructField("count", _S), T.StructField("freq", _S),
])

POSTS = T.StructType([T.StructField("imagefile", _S), T.StructField("caption", _S)])
