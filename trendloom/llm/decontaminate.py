"""Benchmark decontamination as a prefix-filtered set join, in DataFrame
operations only.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
A window is ``size`` consecutive words of an item (an item of fewer words, but
not none, is one window).  A window occurs in a document only if all its words
do, so one word of it, its rarest by the counts over all documents, is the
necessary prefix.  Document words are joined with these prefix words only; the
place of the word bounds where the window starts and ends (a window that would
reach over either end is dropped), and the words at that place are compared in
full.

The window table is written once, and its size is read back: up to
``broadcast_bytes`` it is broadcast, and document words meet it inside the scan.
Beyond, each document word carries its neighbourhood into a shuffle join that
AQE may split by key.  Both ways give the same rows.

Defined results: null and empty texts have no words and are clean; items
without words have no windows; a null item id is left out; documents that
repeat an id get one row each, found by id and text; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.plan import with_computed
from trendloom.llm.common import plain_words_text, stored, stored_bytes, text_key, words_of

WINDOW = 10
BROADCAST_BYTES = 8 << 20


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``win`` (array of words) and ``items`` (ids as strings)."""
    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words_of(plain_words_text(F.col(text_col))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    windows = rows.where(F.size("w") > 0).select("item", F.explode(
        F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    return windows.groupBy("win").agg(F.collect_set("item").alias("items"))


def word_counts(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each word of ``vocabulary`` (column ``word``) stands in all documents."""
    words = docs.select(F.explode(words_of(plain_words_text(F.col(text_col)))).alias("word"))
    small = stored_bytes(vocabulary) <= BROADCAST_BYTES
    return (words.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi")
            .groupBy("word").agg(F.count("*").alias("n")))


def anchored_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest word (ties: the smallest word, then its
    first place) and the place of that word in it, from 0."""
    places = windows.select("win", "items", F.posexplode("win").alias("place", "word"))
    ranked = places.join(counts, "word", "left").select(
        "win", "items", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place").alias("k"))
    return (ranked.groupBy("win").agg(F.min("k").alias("k"), F.first("items").alias("items"))
            .select(F.col("k.word").alias("word"), F.col("k.place").alias("place"), "win", "items"))


def occurrences(docs: DataFrame, anchored: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, key, start, len, items) of every window that occurs in a document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("t"))
    rows = with_computed(rows, "w", words_of(plain_words_text(F.col("t")))).select("doc_id", "key", "w")
    words = rows.select("doc_id", "key", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    start, length = F.col("pos") - F.col("place"), F.size("win")
    fits = (start >= 0) & (start + length <= F.col("n"))
    if stored_bytes(anchored) <= broadcast_bytes:
        met = words.join(F.broadcast(anchored), "word").where(fits & (F.slice("w", start + 1, length) == F.col("win")))
    else:
        around = words.select("doc_id", "key", "n", "pos", "word",
                              F.greatest(F.col("pos") - (size - 1), F.lit(0)).alias("lo"), "w")
        around = around.select("doc_id", "key", "n", "pos", "word", "lo",
                               F.slice("w", F.col("lo") + 1, 2 * size - 1).alias("near"))
        met = around.join(anchored, "word").where(fits & (F.slice("near", start - F.col("lo") + 1, length) == F.col("win")))
    return met.select("doc_id", "key", start.alias("start"), length.alias("len"), "items")


def window_hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, key, start, len, items) of every occurrence of an item's window."""
    windows = stored(item_windows(items, size, text_col="text"), "windows")
    vocabulary = stored(windows.select(F.explode("win").alias("word")).distinct(), "window-words")
    anchored = stored(anchored_windows(windows, word_counts(docs, vocabulary, text_col)), "anchored")
    return occurrences(docs, anchored, id_col, text_col, size, broadcast_bytes)


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents in which a window occurs."""
    hits = window_hits(docs, items, size, id_col, text_col)
    hit = stored(hits.select(F.col("doc_id").alias("_hit_id"), F.col("key").alias("_hit_key")).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(hit["_hit_id"]) & (text_key(docs[text_col]) == hit["_hit_key"])
    return docs.join(F.broadcast(hit) if stored_bytes(hit) <= BROADCAST_BYTES else hit, same, "left_anti")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = window_hits(docs, items, size, id_col, text_col, broadcast_bytes)
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(F.array_sort(F.col("spans")), begin, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["end"], s["start"]))).alias("n")),
        lambda acc: acc["n"])
    # a document's spans and items are bounded by its own words and the item table
    found = hits.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    found = found.select("doc_id", "key", union.alias("n_hit"), "ids")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                       plain_words_text(F.col(text_col)).alias("j"))
    rows = rows.select("doc_id", "key", F.when(F.col("j") == "", 0).otherwise(
        F.length("j") - F.length(F.replace("j", F.lit(" "))) + 1).cast("long").alias("n_words"))
    same = F.expr("d.doc_id <=> f.doc_id and d.key = f.key")
    joined = rows.alias("d").join(found.alias("f"), same, "left")
    ids = F.coalesce(F.col("f.ids"), F.array().cast("array<string>"))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.n_words").alias("n_words"),
        F.coalesce(F.col("f.n_hit"), F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("f.n_hit").isNotNull().alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item, len(w) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM b WHERE len(w) > 0),
wins AS (SELECT least(n, 10) AS n, g, list(DISTINCT item) AS items FROM win GROUP BY ALL),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN sizes)),
hits AS (SELECT doc_id, i, n, items FROM grams JOIN wins USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, unnest(items) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
