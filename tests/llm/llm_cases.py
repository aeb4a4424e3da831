"""Rows for the edge cases, and plain versions of the word rules."""

import random
import re

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns that clash with names the operators use inside or return.
CLASHES = ("t", "w", "n", "key", "word", "words", "score", "kept", "n_words", "class_id", "ids", "start", "digest",
           "held_out", "j", "p", "base", "labels", "items", "spans", "doc", "_id", "_x", "_y", "_kept_id", "_kept_key", "_rows",
           "sample_id", "sample_label", "sample_features", "text_key", "root", "lead", "low", "h", "c", "w1", "pieces", "part", "seq")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def spaced(text):
    return SPACED.findall(text or "")


def plain(text):
    return PLAIN.findall((text or "").translate(AZ))


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ',', ' É', ' été'])}" for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    item = prose(2, 30)
    lines = "The same line of words again.\n" * 40
    near = prose(3, 200).split()
    return [
        (1, None), (2, ""), (3, "one two"), (4, "!!! ??? ###"), (5, long), (6, long), (7, item + " " + prose(4, 60)),
        (7, item + " " + prose(4, 60)), (8, lines), (9, " ".join(near)), (10, " ".join(near[:199] + ["changed"])),
        (11, "Released under the MIT License.\nand cc by nc CC BY NC"), (12, "a b c a b c a b c " * 30),
        (13, prose(5, 80).upper()), (14, "\t\n \x0b"), (None, prose(6, 90)), (None, None), (15, "x" * 5000 + " " + prose(7, 70)),
        (16, "tab\tline\n\x00ctl \x1c\x85 ▁ 日本 ﬁ <|endoftext|> İ Σ 😀"), (17, item[: len(item) // 2]),
    ]


def edge_docs(spark):
    rows = [(i, t, None, None, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
