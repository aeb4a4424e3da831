"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a boolean Column over a document's text and word array that says
"reject".  ``estimate`` runs each rule on a sample of the rows and takes its
share of rejections and its seconds; ``order_rules`` sorts the rules by
rejections per second; ``verdict`` nests them in one CASE expression, so a
document runs only the rules up to the first that rejects it.  The verdict does
not depend on the order, which only saves work.

Defined results: a null or empty text has no words, lines or symbols and fails
``few_words``; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the input, whatever their names, are not read.
Texts are judged whole, whatever their length.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.plan import with_computed
from trendloom.llm.common import let, spaced_words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Low bits of a packed window that hold its place; the rest is hash.
PLACE_BITS = 28


def word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def upper_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Z]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    blank = r" \t\n\x0b\f\r".encode().decode("unicode_escape")
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                    lambda line: F.length(F.btrim(line, F.lit(blank))) > 0)


def dup_line_count(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_words(text),
               lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def repeat_word_count(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the text.

    Windows are packed as (hash bits, place) longs and sorted; windows with a
    neighbour of the same hash are the candidates, and only these are compared
    by their words.  The places of the true repeats are then merged."""
    low = (1 << PLACE_BITS) - 1

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

    def by_hash(s: Column) -> Column:
        same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
        return F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False))
                        | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))

    def by_words(w: Column, candidates: Column) -> Column:
        return F.array_sort(F.transform(candidates, lambda x: let(
            x.bitwiseAND(F.lit(low)).cast("int"),
            lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"),
                               p.alias("p")))))

    def repeated(s: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False))
                     | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))), lambda x: x["p"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    none = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) < 3, none).otherwise(
        let(let(F.sort_array(windows(w)), by_hash), lambda found: F.when(F.size(found) == 0, none).otherwise(
            let(by_words(w, found), lambda s: let(repeated(s), covered))))))


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for a document to drop."""
    name: str
    rejects: Callable[[Column, Column], Column]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda t, w: F.size(w) < MIN_WORDS),
        Rule("repeats", lambda t, w: 100 * repeat_word_count(w) > MAX_REPEAT_PERCENT * F.size(w)),
    ]


def further_rules() -> list[Rule]:
    """Rules of this library beside the base ones; each needs a strong sign,
    so that ordinary prose passes."""
    return [
        Rule("symbols", lambda t, w: symbol_count(t) > F.size(w)),
        Rule("shouting", lambda t, w: 2 * upper_count(t) > F.length(F.coalesce(t, F.lit("")))),
        Rule("dup_lines", lambda t, w: let(lines_with_words(t), lambda x: (
            2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x)))),
        Rule("long_words", lambda t, w: word_chars(w) > 25 * F.size(w)),
        Rule("few_kinds", lambda t, w: 20 * F.size(F.array_distinct(w)) < F.size(w) - 2000),
    ]


def verdict(rules: list[Rule], text: Column, words: Column) -> Column:
    """True if no rule rejects; rules after the first that rejects do not run."""
    kept: Column = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(F.coalesce(rule.rejects(text, words), F.lit(False)), F.lit(False)).otherwise(kept)
    return kept


def estimate(docs: DataFrame, rules: list[Rule], text_col: str = "text",
             sample_rows: int = 2000, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Per rule the share of sampled rows that it rejects and its seconds a row.

    The sample holds about ``sample_rows`` rows drawn from the whole table; it
    decides the order of the rules and nothing else."""
    total = docs.count()
    drawn = docs.select(F.col(text_col).alias("t")).sample(min(1.0, sample_rows / max(total, 1)), seed)
    sample = with_computed(drawn, "w", spaced_words(F.col("t"))).persist()
    try:
        n = max(sample.count(), 1)
        found = {}
        for rule in rules:
            job = sample.agg(F.sum(F.coalesce(rule.rejects(F.col("t"), F.col("w")), F.lit(False)).cast("long")))
            rejected = job.first()[0] or 0  # compiles the plan
            began = time.perf_counter()
            job.first()
            found[rule.name] = (rejected / n, (time.perf_counter() - began) / n)
        return found
    finally:
        sample.unpersist()


def order_rules(rules: list[Rule], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing on the
    sample come last, the cheapest first."""
    def gain(rule: Rule) -> tuple[float, float]:
        share, seconds = estimates[rule.name]
        return (-share / max(seconds, 1e-12), seconds)
    return sorted(rules, key=gain)


def keep_mask(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
              sample_rows: int = 2000) -> Column:
    """A Column that is true for the documents which pass every rule; it can
    filter ``docs`` without adding or renaming columns."""
    rules = base_rules() + further_rules() if rules is None else rules
    ordered = order_rules(rules, estimate(docs, rules, text_col, sample_rows))
    return let(spaced_words(F.col(text_col)), lambda w: verdict(ordered, F.col(text_col), w))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = 2000) -> DataFrame:
    """One row per document: the base counts, ``base_failed`` and ``kept``."""
    rules = further_rules()
    ordered = order_rules(rules, estimate(docs, rules, text_col, sample_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    t, w = F.col("t"), F.col("w")
    rows = with_computed(rows, "w", spaced_words(t))
    rows = with_computed(rows, "n_repeat_words", repeat_word_count(w))
    counted = rows.select(
        "doc_id", F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"),
        symbol_count(t).alias("n_symbols"), dup_line_count(t).alias("n_dup_lines"), "n_repeat_words",
        ((F.size(w) < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.size(w)))
        .alias("base_failed"), "t", "w")
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "base_failed",
                          F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(ordered, t, w)).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(t) AS n_text,
    len(list_distinct(w)) AS n_kinds
  FROM d JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR 2 * n_upper > n_text
       OR 2 * n_dup_lines > n_lines OR word_chars > 25 * n_words OR 20 * n_kinds < n_words - 2000) AS kept
FROM s
"""
