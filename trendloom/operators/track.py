"""Tracked-phrase filter.

Semantics: a phrase matches a status when every term of the phrase occurs
among the status's tokens (any order, case-insensitive, same cleaning and
tokenizer for both); phrases are OR-ed.  A phrase without terms matches
nothing.

An anchored index, in batch and in the stream: each phrase is indexed by one of its
terms, the one that the fewest phrases have (then the longest), so a word that many
phrases share is the anchor of none that has a rarer one.  A status meets a phrase only
if it holds the phrase's anchor, and what meets is then verified in full.

Common words make far more meetings than there are statuses, so they are never rows:
statuses (with their terms) and phrases (with their anchors) are dealt to the cells of
a grid, of at most about ``TERMS_AT_ONCE`` terms and ``PHRASES_AT_ONCE`` phrases,
and a cell counts its matches in its task.  The terms of a status are sent once for each block of
phrases, a phrase once for each group of statuses.  With a short list only the tracked terms of a
status go on: they are found inside the scan.  A status is known
by its id and a hash of its text, so a status that is delivered twice, or two
statuses under one id, are told apart by what they say.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import clean_tokens, phrase_terms
from trendloom.session import ship_package, written_once

PHRASES_AT_ONCE = 1 << 21  # of a block of phrases
TERMS_AT_ONCE = 1 << 22    # of the statuses of a group
SHORT_LIST = 1 << 14       # tracked terms that are looked up inside the scan


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """One phrase per line; surrounding blanks trimmed, blank lines
    dropped.  Duplicates are removed (a phrase is a set member)."""
    return (spark.read.text(path)
            .select(F.trim(F.col("value")).alias("phrase"))
            .where(F.col("phrase") != "").distinct())


def phrase_table(phrases: DataFrame) -> DataFrame:
    """(phrase, terms) with terms the distinct tokens of the phrase; phrases
    without any term are dropped."""
    return (phrases.select("phrase", phrase_terms("phrase").alias("terms"))
            .where(F.size("terms") > 0))


def _text(text_col) -> Column:
    return F.col(text_col) if isinstance(text_col, str) else text_col


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def phrase_anchors(phrases: DataFrame) -> DataFrame:
    """(phrase, anchor, rest): the phrase's term that the fewest phrases have (then
    the longest, then the first by name), and its other terms."""
    terms = phrase_table(phrases).select("phrase", F.explode("terms").alias("term"))
    spread = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", -F.length("term"), "term"))
    found = terms.join(spread, "term").groupBy("phrase").agg(rarest["term"].alias("anchor"), F.collect_list("term").alias("terms"))
    return found.select("phrase", "anchor", F.array_remove("terms", F.col("anchor")).alias("rest"))


def held_terms(statuses: DataFrame, phrases: DataFrame, id_col: str = "tweet_id", text_col="text") -> DataFrame:
    """(_id, _key, term): the terms of any phrase that each distinct status holds."""
    text = _text(text_col)
    tok = statuses.select(F.col(id_col).alias("_id"), _key(text).alias("_key"),
                          F.explode(F.array_distinct(clean_tokens(text))).alias("term"))
    terms = F.concat(F.array("anchor"), "rest") if "anchor" in phrases.columns else F.col("terms")
    listed = phrases if "anchor" in phrases.columns else phrase_table(phrases)
    tracked = listed.select(F.explode(terms).alias("term")).distinct()
    # distinct: a repeated delivery must not count its terms twice
    return tok.join(tracked, "term", "left_semi").select("_id", "_key", "term").distinct()


def anchored(held: DataFrame, anchors: DataFrame) -> DataFrame:
    """(_id, _key, phrase, rest): each status with the phrases whose anchor it holds."""
    return held.join(anchors, F.col("term") == F.col("anchor")).select("_id", "_key", "phrase", "rest")


def phrase_index(phrases: DataFrame) -> DataFrame:
    """The anchors of a list, written once; every function here takes it in the list's place."""
    return written_once(phrase_anchors(phrases.select("phrase").distinct()), "phrase-index")


def _term_lists(statuses: DataFrame, index: DataFrame, id_col: str, text_col) -> DataFrame:
    """(_id, _key, terms): the distinct terms of each status; with a short list only those tracked."""
    text = _text(text_col)
    if index.select(F.explode(F.concat(F.array("anchor"), "rest"))).limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        return held_terms(statuses, index, id_col, text_col).groupBy("_id", "_key").agg(F.collect_list("term").alias("terms"))
    return statuses.select(F.col(id_col).alias("_id"), _key(text).alias("_key"),
                           F.array_distinct(clean_tokens(text)).alias("terms"))


class _Block:
    """The phrases of a cell, in the order of their anchors."""

    def __init__(self, table):
        import pyarrow as pa
        import pyarrow.compute as pc
        anchors, rests = table.column("anchor").combine_chunks(), table.column("rest").combine_chunks()
        words = rests.flatten()
        self.vocabulary = pc.unique(pa.concat_arrays([anchors, words]))
        n = len(self.vocabulary)
        anchor = pc.index_in(anchors, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        word = pc.index_in(words, value_set=self.vocabulary).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
        ends = np.cumsum(rests.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        self.order = np.argsort(anchor, kind="stable")
        self.starts = np.searchsorted(anchor[self.order], np.arange(n + 1))
        first = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        one = ends > first
        other = np.full(len(anchor), n, np.int64)  # always held
        other[one] = word[first[one]]
        self.other = other[self.order]
        self.more = {i: word[first[j] + 1:ends[j]] for i, j in enumerate(self.order.tolist()) if ends[j] - first[j] > 1}
        self.long = np.zeros(len(anchor), bool)
        self.long[list(self.more)] = True
        self.held = np.zeros(n + 1, bool)
        self.held[n] = True

    def matched(self, terms: np.ndarray) -> np.ndarray:
        """The phrases whose terms are all among ``terms`` (numbers of the vocabulary)."""
        lo = self.starts[terms]
        sizes = self.starts[terms + 1] - lo
        ends = np.cumsum(sizes)
        met = np.arange(ends[-1]) + np.repeat(lo - ends + sizes, sizes)
        self.held[terms] = True
        met = met[self.held[self.other[met]]]
        long = self.long[met]
        if long.any():
            whole = ~long
            whole[long] = [self.held[self.more[i]].all() for i in met[long].tolist()]
            met = met[whole]
        self.held[terms] = False
        return self.order[met]


def _cell(pairs: bool):
    """Counts (or names) the phrases that each status of a cell matches."""
    def run(statuses, phrases):
        import pyarrow as pa
        import pyarrow.compute as pc
        out = {"_row": [], "what": []}
        if statuses.num_rows and phrases.num_rows:
            block = _Block(phrases)
            lists = statuses.column("terms").combine_chunks()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            number = pc.index_in(lists.flatten(), value_set=block.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.flatnonzero(number >= 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)[known]
            number = number[known].astype(np.int64)
            rows, starts = np.unique(owner, return_index=True)
            for row, lo, hi in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(number)], strict=True):
                found = block.matched(number[lo:hi])
                if len(found):
                    out["_row"].append(np.full(len(found) if pairs else 1, row))
                    out["what"].append(found if pairs else np.array([len(found)]))
        row, what = (np.concatenate([np.zeros(0, np.int64), *out[k]]) for k in ("_row", "what"))
        part = statuses.select(["_id", "_key", "_block"]).take(pa.array(row))
        last = phrases.column("phrase").take(pa.array(what)) if pairs else pa.array(what)
        return part.append_column("phrase" if pairs else "n", last)
    return run


def _texts_spread(statuses: DataFrame, id_col: str, text_col) -> DataFrame:
    """The ids and texts, dealt to as many tasks as can run if their files make fewer."""
    texts = statuses.select(F.col(id_col).alias(id_col), _text(text_col).alias("_text"))
    tasks = statuses.sparkSession.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= tasks else texts.repartition(tasks, id_col)


def _matched(statuses: DataFrame, phrases: DataFrame, id_col: str, text_col, pairs: bool) -> DataFrame:
    """(_id, _key, _block, phrase), or with the number ``n`` of a block's phrases: one row for each delivery
    of a status and each of its matches, or each block that has some."""
    spark = statuses.sparkSession
    ship_package(spark)
    index = phrases if "anchor" in phrases.columns else phrase_index(phrases)
    lists = written_once(_term_lists(statuses, index, id_col, text_col), "status-terms")
    n_phrases, n_terms = index.count(), lists.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, groups = -(-n_phrases // PHRASES_AT_ONCE) or 1, -(-n_terms // TERMS_AT_ONCE) or 1
    # small lists: the groups are as many as the tasks that can run
    groups = max(groups, min(spark.sparkContext.defaultParallelism, -(-n_terms // 4096) or 1))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = lists.withColumn("_group", F.pmod(F.xxhash64("_id", "_key"), F.lit(groups)).cast("int")).withColumn("_block", cells(blocks))
    right = index.withColumn("_block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int")).withColumn("_group", cells(groups))
    kind = dict(lists.dtypes)["_id"]
    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(
        _cell(pairs), f"_id {kind}, _key long, _block int, {'phrase string' if pairs else 'n long'}")


def match_phrases(statuses: DataFrame, phrases: DataFrame, id_col: str = "tweet_id",
                  text_col="text") -> DataFrame:
    """(id, phrase) pairs; a status that is delivered twice gives its pairs once."""
    return (_matched(statuses, phrases, id_col, text_col, True)
            .select(F.col("_id").alias(id_col), "phrase").distinct())


def track_filter(statuses: DataFrame, phrases: DataFrame, id_col: str = "tweet_id",
                 text_col="text", few_files: bool = False) -> DataFrame:
    """the statuses matching at least one phrase, each delivery of them,
    with the number of matched phrases (``n_phrases``).  ``few_files`` says that the statuses
    are a scan whose files may be fewer than the tasks that can run: the texts are then dealt to all of them,
    as to find the terms takes most of the time."""
    texts, text_in = (_texts_spread(statuses, id_col, text_col), "_text") if few_files else (statuses, text_col)
    found = _matched(texts, phrases, id_col, text_in, False)
    # repeated deliveries say the same; written, so that few of them are broadcast and no text is shuffled
    counts = written_once(found.groupBy("_id", "_key", "_block").agg(F.max("n").alias("n"))
                     .groupBy("_id", "_key").agg(F.sum("n").alias("n_phrases")), "phrase-counts")
    text = _text(text_col)
    return (statuses.withColumn("_status_key", _key(text))
            .join(counts, (F.col(id_col) == F.col("_id")) & (F.col("_status_key") == F.col("_key")))
            .drop("_id", "_key", "_status_key"))
