"""Term statistics over a text column.

Shape of every job: texts -> (clean, tokenize: one expression) -> explode ->
partial+final hash aggregate on the term (map-side combine absorbs hot
terms such as '#' or 'the') -> scalar subquery for totals -> top-n with
TakeOrderedAndProject.  Nothing is collected; no Python in the hot path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.stopwords import ENGLISH_STOP_WORDS
from trendloom.functions.text import clean_tokens, ngrams_range
from trendloom.operators.prefix import ordinal
from trendloom.session import checkpoint_dir


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stop_words: Sequence[str] | DataFrame | None = ENGLISH_STOP_WORDS,
              url_mode: str = "line", tokenizer=None) -> DataFrame:
    """One row per token occurrence: (id_col, term), stop words removed.

    Lower-casing precedes tokenizing; stop words are removed after it.  A
    list of stop words becomes an InSet predicate (hash lookup inside
    codegen); a DataFrame of stop words (column ``term``) becomes a left
    anti join whose strategy AQE chooses by its runtime size.  ``tokenizer``
    (Column -> array<string> Column) replaces the built-in clean + tokenize.
    """
    tok = tokenizer(F.col(text_col)) if tokenizer is not None else clean_tokens(text_col, url_mode)
    t = docs.select(F.col(id_col), F.explode(tok).alias("term"))
    if stop_words is None:
        return t
    if isinstance(stop_words, DataFrame):
        return t.join(stop_words.select("term"), "term", "left_anti").select(id_col, "term")
    return t.where(~F.col("term").isin(list(stop_words)))


def term_document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """A1: the sparse term-document matrix in long form (id, term, n)."""
    return (doc_terms(docs, id_col, text_col, stop_words)
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n")))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words=ENGLISH_STOP_WORDS, tokenizer=None) -> DataFrame:
    """A2: occurrences per term over all texts (term, n)."""
    return (doc_terms(docs, id_col, text_col, stop_words, tokenizer=tokenizer)
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def total_words(counts: DataFrame) -> DataFrame:
    """A3: grand total of surviving tokens, one row (total)."""
    return counts.agg(F.sum("n").cast("long").alias("total"))


def total_scalar(counts: DataFrame) -> Column:
    """A3 as a scalar subquery column: evaluated once, inlined as a value,
    no join and no collect."""
    return total_words(counts).scalar()


def term_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   stop_words=ENGLISH_STOP_WORDS, materialize: bool = True,
                   tokenizer=None) -> DataFrame:
    """A4: (term, n, tf) with tf = n / total.

    The total needs every count, and a scalar subquery over the same
    aggregate would tokenize the texts a second time (the subquery's
    exchange is not shared with the main plan).  So the aggregated counts
    - one row per term, far smaller than the texts - are written once as a
    reliable checkpoint in the shared checkpoint folder; the total and the
    tf column both read that.
    """
    counts = term_counts(docs, id_col, text_col, stop_words, tokenizer)
    if materialize:
        checkpoint_dir(counts.sparkSession)
        counts = counts.checkpoint(eager=True)
    return counts.withColumn("tf", F.col("n").cast("double") / total_scalar(counts).cast("double"))


def baseline_from_texts(texts: DataFrame, id_col: str, text_col: str = "text",
                        stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Baseline frequency table (term, freq) built from a second corpus with
    the same cleaning and tokenizing (A4 over that corpus)."""
    return term_frequency(texts, id_col, text_col, stop_words).select(
        "term", F.col("tf").alias("freq"))


def relative_frequency(tf: DataFrame, baseline: DataFrame, min_count: int | None = 10) -> DataFrame:
    """A5 + J2 + F9: terms present in the baseline, rel = tf / baseline.

    The raw-count threshold (strict ``n > min_count``) is applied before the
    join, so only surviving terms are shuffled.  Both sides are aggregated
    on ``term``; the join is an inner equi-join whose strategy (broadcast or
    sort-merge) AQE picks from runtime sizes - a baseline vocabulary can be
    large, so no broadcast is forced.
    """
    if min_count is not None:
        tf = tf.where(F.col("n") > min_count)
    b = baseline.select("term", F.col("freq").alias("baseline"))
    return (tf.join(b, "term")
              .withColumn("rel", F.col("tf") / F.col("baseline")))


def top_n(df: DataFrame, order: Sequence[Column], n: int | None, rank_col: str = "rank") -> DataFrame:
    """The first n rows in ``order`` with a 1-based rank.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject (per-partition
    top-n, then a merge of n rows per partition).  The rank window runs on
    those n rows only.  ``n=None`` ranks everything with the distributed
    running count; ``order`` must then be total.
    """
    if n is None:
        return ordinal(df, order, out=rank_col)
    head = df.orderBy(*order).limit(n)
    # bounded: at most n rows reach this window (after the limit).
    w = Window.orderBy(*order)
    return head.withColumn(rank_col, F.row_number().over(w).cast("long"))


def frequent_terms(docs: DataFrame, n: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """The n most frequent terms (ties: term ascending)."""
    tf = term_frequency(docs, id_col, text_col, stop_words)
    return top_n(tf, [F.col("n").desc(), F.col("term").asc()], n)


def trending_terms(docs: DataFrame, baseline: DataFrame, n: int | None = 400,
                   min_count: int | None = 10, id_col: str = "doc_id", text_col: str = "text",
                   stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """T2 on A5: terms ranked by tf / baseline, raw count > min_count."""
    tf = term_frequency(docs, id_col, text_col, stop_words)
    rel = relative_frequency(tf, baseline, min_count)
    return top_n(rel, [F.col("rel").desc(), F.col("term").asc()], n)


def document_frequency(docs: DataFrame, max_n: int = 3, id_col: str = "doc_id",
                       text_col: str = "text", tokenizer=None, up_to: str | None = None) -> DataFrame:
    """A6 input: documents containing each 1..max_n-gram (gram, df); with ``up_to``
    only the grams that are not beyond it in order.

    No stop words (the reference's IDF job keeps them).  ``array_distinct``
    per document makes each document emit each gram once, so no
    distinct-(doc, gram) shuffle is needed; the count is a partial+final
    hash aggregate on the gram.
    """
    # tokens are projected first: the n-gram lambdas must read a column, not
    # re-run the tokenizer per gram position.
    tok = tokenizer(F.col(text_col)) if tokenizer is not None else clean_tokens(text_col)
    toks = docs.select(tok.alias("_tok"))
    grams = F.array_distinct(ngrams_range("_tok", 1, max_n))
    found = toks.select(F.explode(grams).alias("term"))
    if up_to is not None:
        found = found.where(F.col("term") <= F.lit(up_to))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _with_idf(dfreq: DataFrame, docs: DataFrame) -> DataFrame:
    n_docs = docs.agg(F.count(F.lit(1)).alias("N")).scalar()
    return dfreq.withColumn(
        "idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def idf_grams(docs: DataFrame, max_n: int = 3, id_col: str = "doc_id", text_col: str = "text",
              counted: DataFrame | None = None) -> DataFrame:
    """Smoothed idf = ln((1 + N) / (1 + df)) + 1 over 1..max_n-grams; N
    counts every document, also those left without tokens.  ``counted`` has
    the same rows as ``docs`` and is cheaper to count (a plain scan)."""
    dfreq = document_frequency(docs, max_n, id_col, text_col)
    return _with_idf(dfreq, docs if counted is None else counted)


def _first_grams(docs: DataFrame, text_col: str, max_n: int, share: float, k: int) -> str | None:
    """The ``k``-th gram, in order, among those of a ``share`` of the documents; None if there are fewer."""
    some = docs.sample(share, seed=1).select(clean_tokens(text_col).alias("_tok"))
    grams = some.select(F.explode(ngrams_range("_tok", 1, max_n)).alias("term"))
    head = grams.orderBy("term").limit(k).agg(F.count(F.lit(1)).alias("n"), F.max("term").alias("last")).first()
    return head["last"] if head["n"] == k else None


def rarest_grams(docs: DataFrame, n: int, max_n: int = 3, text_col: str = "text", share: float = 0.01) -> DataFrame:
    """The ``n`` first grams by (df asc, term asc), as (term, df, idf), with little shuffled.

    A threshold algorithm: no gram has a smaller df than 1, so once ``n`` grams
    up to a bound have df 1, no gram beyond the bound can come before them.  The bound is
    guessed from a sample of the documents; grams beyond it are dropped before the
    shuffle, those up to it are counted in all documents.  If fewer than ``n`` of them have df 1 the bound is
    moved out 16-fold, and at last away, so the result is exact whatever the sample."""
    k = 2 * n
    while (bound := _first_grams(docs, text_col, max_n, share, k)) is not None:
        dfreq = document_frequency(docs, max_n, text_col=text_col, up_to=bound)
        head = dfreq.where(F.col("df") == 1).orderBy("term").limit(n).checkpoint()
        if head.count() == n:
            return _with_idf(head, docs)
        k *= 16
    return _with_idf(document_frequency(docs, max_n, text_col=text_col).orderBy("df", "term").limit(n), docs)


def tfidf_terms(docs: DataFrame, n: int | None = 400, max_n: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The n highest-idf (rarest) grams.  idf falls strictly with
    df, so the order is (df asc, term asc): exact integers, no float ties."""
    if n is not None:
        checkpoint_dir(docs.sparkSession)
        idf = rarest_grams(docs, n, max_n, text_col)
    else:
        idf = idf_grams(docs, max_n, id_col, text_col)
    return top_n(idf, [F.col("df").asc(), F.col("term").asc()], n)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Distinct terms (sorted on output by the caller if needed)."""
    return doc_terms(docs, id_col, text_col, stop_words).select("term").distinct()
