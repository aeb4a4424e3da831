"""License scans as an exact set-similarity join, in DataFrame operations only.

A text block is a line (``\\n``-separated) of a document; its tokens are the
words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A block
carries a template's label if it holds at least ``threshold`` of the template's
distinct tokens.  Template tokens are ordered by their counts over all
documents, rarest first.  A block that meets the threshold must hold one of the
template's first ``size - need + 1`` tokens (prefix filter), ``need`` words at
least (length filter).  Only blocks that pass are compared in full.  There is no
positional filter: behind every prefix token ``need`` tokens are left.

Beside that the base phrases are found wherever their words stand
consecutively, over line ends too.

Templates and phrases are arguments, so their tokens are bounded and are held
in the plan.  Defined results: null and empty texts have no words, no labels
and score 0; documents that repeat an id get one row each, found by id and
text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.plan import with_computed
from trendloom.llm.common import LOWER, NON_WORD_CLASS, UPPER, plain_words_text, text_key, words_of

#: The contract's phrases.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Public notices, shortened to their telling sentence.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
)
THRESHOLD = 0.9


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def token_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each token of the templates stands in all documents."""
    words = docs.select(F.explode(words_of(plain_words_text(F.col(text_col)))).alias("word"))
    counted = words.where(F.col("word").isin(vocabulary)).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counted.collect()}


def prefixes(templates, counts: dict[str, int], threshold: float = THRESHOLD) -> list[tuple]:
    """(token, label, rank, need, tokens) of every prefix token of every template."""
    rows = []
    for label, text in templates:
        tokens = sorted(set(text.split()), key=lambda w: (counts[w], w))
        need = _need(len(tokens), threshold)
        rows += [(tokens[i], label, i, need, tokens) for i in range(len(tokens) - need + 1)]
    return rows


def matching_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, line, label, containment) of every block that meets the
    threshold; a block may come once for each prefix token that it holds."""
    spark = docs.sparkSession
    counts = token_counts(docs, sorted({w for _, t in templates for w in t.split()}), text_col)
    table = spark.createDataFrame(prefixes(templates, counts, threshold),
                                  "word string, label string, rank int, need int, tokens array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("t"))
    # all word separators but the line end become a space
    inner = NON_WORD_CLASS.replace(r"\x00-\x2F", r"\x00-\x09\x0B-\x2F")
    flat = F.translate(F.regexp_replace(F.coalesce("t", F.lit("")), inner, " "), UPPER, LOWER)
    blocks = rows.select("doc_id", "key", F.posexplode(F.split(flat, "\n")).alias("line", "b"))
    blocks = with_computed(blocks, "w", words_of(F.trim("b"))).select("doc_id", "key", "line", "w")
    words = blocks.select("doc_id", "key", "line", "w", F.explode("w").alias("word"))
    met = words.join(F.broadcast(table), "word")  # as many rows as the templates have prefix tokens
    passed = met.where((F.size("w") >= F.col("need")) & (F.size("tokens") - F.col("rank") >= F.col("need")))
    shared = with_computed(passed, "shared", F.size(F.array_intersect("tokens", "w")))
    return shared.where(F.col("shared") >= F.col("need")).select(
        "doc_id", "key", "line", "label", (F.col("shared") / F.size("tokens")).alias("containment"))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def phrase_places(joined: Column, n_words: Column, phrase: str) -> Column:
    """(n, first, last) of the places of ``phrase`` in a single-spaced string,
    by word; places may overlap."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"),
                    F.lit(None).cast("long").alias("last"))
    padded = F.concat(F.lit("^ "), joined, F.lit(" "))
    parts = F.split(padded, f"(?= {phrase} )")
    found = F.element_at(F.transform(F.array(parts), lambda p: F.struct(
        (F.size(p) - 1).cast("long").alias("n"), _spaces(F.element_at(p, 1)).cast("long").alias("first"),
        (n_words - _spaces(F.element_at(p, -1)) + 1).cast("long").alias("last"))), 1)
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found).otherwise(none)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base places, labels and score."""
    blocks = matching_blocks(docs, templates, threshold, id_col, text_col)
    found = blocks.groupBy("doc_id", "key").agg(F.collect_set("label").alias("labels"),
                                                F.max("containment").alias("score"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("t"))
    rows = with_computed(rows, "j", plain_words_text(F.col("t")))
    rows = rows.select("doc_id", "key", "j", F.when(F.col("j") == "", 0).otherwise(
        _spaces(F.col("j")) + 1).cast("long").alias("n_words"))
    rows = with_computed(rows, "p", F.array(*[phrase_places(F.col("j"), F.col("n_words"), p) for _, p in phrases]))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    base = F.array_distinct(F.sort_array(F.filter(F.array(*[
        F.when(F.get("p", F.lit(i))["n"] > 0, F.lit(label)) for i, (label, _) in enumerate(phrases)]),
        lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "key", "n_words", total.alias("n_base"),
                       F.array_min(F.transform("p", lambda x: x["first"])).alias("first_word"),
                       F.array_max(F.transform("p", lambda x: x["last"])).alias("last_word"), base.alias("base"))
    joined = rows.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.key = f.key"), "left")
    nothing = F.array().cast("array<string>")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("labels", nothing))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def oracle_sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    tpl = ",\n  ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {_need(len(set(t.split())), threshold)})"
                       for label, t in templates)
    phr = ", ".join(f"('{label}', {quoted(p.split())})" for label, p in phrases)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w, {lower} AS t FROM documents),
tpl(label, tokens, need) AS (VALUES {tpl}),
phr(label, words) AS (VALUES {phr}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {word})) AS b FROM d),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(tokens, b)) / len(tokens)) AS score
  FROM blocks CROSS JOIN tpl WHERE len(list_intersect(tokens, b)) >= need GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
places AS (SELECT doc_id, label, i - 1 AS p FROM pos JOIN phr ON w[i] = words[1] AND w[i:i + len(words) - 1] = words),
base AS (
  SELECT doc_id, count(*) AS n, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
