"""Token counts through a digest cache.

A text's key is the sha256 of its normalised content (null counts as the empty
text; nothing else may change, as the counts are those of the raw text).  The
cache is a Parquet table of (tokenizer, key, n_tokens), partitioned by the
tokenizer's digest.  Keys that the cache lacks are reduced to one text each,
these are encoded, and their counts are appended; then every document takes its
count from the cache by key.

Copies are reduced to one text below the shuffle (partial aggregation), so a
group of copies that holds a third of all rows sends one text from each task.
The join that gives the counts back moves keys, not texts, and AQE may split a
hot key.  A lost task runs again and gives the same rows; an append that fails
leaves nothing behind, and a cache with repeated keys (two runs at once) is read
with one count for each key.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
and rows that share an id get one row each; an empty table gives an empty result
and leaves the cache as it is; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.tokenizer_files import in_slices, memo_of, public_path, version_digest

OVER = 512
CACHE_SCHEMA = "key binary, n_tokens long, tokenizer string"
TOKENIZER = "byte_bpe_50k.json"


def text_digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _counter(path: str):
    """Maps batches of (key, t) to (key, n_tokens)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(ids) for ids in model.encode(texts)]
        else:
            memo = memo_of(path)
            count = lambda texts: [len(ids) // 4 for ids in memo.encode_all(texts)]
        for batch in batches:
            counts = [n for texts in in_slices(batch.column(1)) for n in count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])
    return run


def cached_counts(spark, cache_path: str, digest: str) -> DataFrame:
    """(key, n_tokens) of one tokenizer, one row for each key."""
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == digest)
    return cache.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache_path: str, path: str, text_col: str = "text") -> None:
    """Append the counts of texts that the cache lacks."""
    spark, digest = docs.sparkSession, version_digest(path)
    # makes the folder, so that the reads below find a table
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    texts = docs.select(text_digest(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    have = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == digest)
    if not have.isEmpty():
        texts = texts.join(have.select("key").distinct(), "key", "left_anti")
    misses = texts.groupBy("key").agg(F.first("t").alias("t"))
    counted = misses.mapInArrow(_counter(path), "key binary, n_tokens long")
    (counted.withColumn("tokenizer", F.lit(digest)).write.mode("append").partitionBy("tokenizer").parquet(cache_path))


def count_tokens(docs: DataFrame, cache_path: str, path: str | None = None, over: int = OVER,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = path or public_path(TOKENIZER)
    fill_cache(docs, cache_path, path, text_col)
    counts = cached_counts(docs.sparkSession, cache_path, version_digest(path))
    keys = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("key"),
                       F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    return keys.join(counts, "key").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
