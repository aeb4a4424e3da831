"""Phrase collocations from sorted count streams.

Counting goes level by level.  Phrases of k words are counted only where both
their parts of k - 1 words reach ``min_count`` (a phrase is never more frequent than
a part of it, so nothing is lost).  Tasks see that by a bit table of the frequent
parts; it has a fixed largest size, and where it is too small it only lets more
phrases through to the exact count.

The frequent phrases of all lengths are then laid out as two streams: in prefix
order (first word first), where each phrase follows its own first parts, and in
suffix order (last word first), where it follows its last parts.  One pass over
either stream, in step through all lengths, gives each phrase the counts of its
parts and the largest count of a phrase that extends it by a word; it holds one
open phrase for each length and no table.  Streams are dealt by ranges of the whole
phrase, so the phrases of a frequent first word lie in many tasks; what a part
needs from the one before are boundary records, one for each length.  The two
streams are merge-joined by phrase.

Defined results: null texts are empty; a null language counts as ``und``; rows that
repeat count each time; ids are not read, so nulls and ties among them do not
matter; an empty table gives an empty table; other columns are not read.  Counts up
to 10^16 keep the arithmetic of the score exact (38 digits).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import stored

#: What ends a piece, and the words of a piece.
TOKENS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
MIN_COUNT, MAX_WORDS, TOP, COVER_PERCENT = 10, 3, 2000, 50
#: Bytes of text whose phrases are counted together before they leave a task.
BATCH_BYTES = 5 << 20
FILTER_BITS = 1 << 28
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of the phrases whose words have the hashes ``parts``."""
    out = parts[0].copy()
    for p in parts[1:]:
        out = (out ^ (out >> np.uint64(29))) * _MIX + p
    return out ^ (out >> np.uint64(32))


class _Ids(dict):
    """Word -> number from 1; what ends a piece is 0."""

    def __missing__(self, token: bytes) -> int:
        got = self[token] = 0 if token[0] in ENDS else self.fresh
        self.fresh += got > 0
        return got

    fresh = 1


def _phrases(lang: str, texts: list[bytes], k: int, known: tuple[int, np.ndarray] | None):
    """(words, numbers of the words by place in the phrase, counts) of the
    distinct phrases of ``k`` words of some texts of one language."""
    ids = _Ids()
    at = np.fromiter(map(ids.__getitem__, TOKENS.findall(b"\n".join(texts).lower())), np.int64)
    words = [b"", *(w for w, i in ids.items() if i)]
    if k == 1:
        counts = np.bincount(at, minlength=len(words))
        counts[0] = counts[1:].sum()
        return words, [np.arange(len(words))], counts
    n = len(at) - k + 1
    if n <= 0:
        return words, [np.zeros(0, np.int64)] * k, np.zeros(0, np.int64)
    whole = np.logical_and.reduce([at[j:n + j] != 0 for j in range(k)])
    places = np.flatnonzero(whole)
    hashes, salt = _hashed(words), _hashed([lang.encode()])[0]
    bits, table = known
    for part in (0, 1):
        h = _joined([hashes[at[places + part + j]] + salt for j in range(k - 1)]) % np.uint64(bits)
        places = places[(table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    code = np.zeros(len(places), np.int64)
    # numbers of the words met, made dense so that k of them fit one integer
    used = np.unique(np.concatenate([at[places + j] for j in range(k)])) if len(places) else np.zeros(0, np.int64)
    dense = np.zeros(len(words), np.int64)
    dense[used] = np.arange(len(used))
    base = max(len(used), 1)
    if base ** k < 1 << 62:
        for j in range(k):
            code = code * base + dense[at[places + j]]
        code, counts = np.unique(code, return_counts=True)
        columns = []
        for _ in range(k):
            columns.append(used[code % base] if len(used) else code)
            code = code // base
        return words, columns[::-1], counts
    rows, counts = np.unique(np.stack([at[places + j] for j in range(k)], 1), axis=0, return_counts=True)
    return words, list(rows.T), counts


def _counter(k: int, known, batch_bytes: int):
    """Tasks' side of ``count_level``; ``known`` is a broadcast bit table."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, texts in held.items():
                words, columns, counts = _phrases(lang, texts, k, known and known.value)
                pool = pa.array(words, pa.binary()).cast(pa.string())
                for lo in range(0, len(counts), 200_000):
                    part = slice(lo, lo + 200_000)
                    cols = [pool.take(pa.array(c[part])) for c in columns]
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *cols, pa.array(counts[part], pa.int64())],
                                                     ["lang", *(f"w{j + 1}" for j in range(k)), "c"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for lang, text in zip(langs, texts.to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= batch_bytes:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()
    return run


def count_level(docs: DataFrame, k: int, known=None, min_count: int = MIN_COUNT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(lang, w1..wk, c) of the phrases of ``k`` words met ``min_count`` times or
    more.  With one word, the row whose word is '' holds the language's total."""
    keys = ["lang", *(f"w{j + 1}" for j in range(k))]
    schema = ", ".join(f"{c} string" for c in keys) + ", c long"
    found = docs.mapInArrow(_counter(k, known, batch_bytes), schema).groupBy(*keys).agg(F.sum("c").alias("c"))
    return found.where((F.col("c") >= min_count) | (F.col("w1") == ""))


def _bits_of(k: int, bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            salt, *parts = [_hashed([s.encode() for s in batch.column(j).to_pylist()]) for j in range(k + 1)]
            h = np.unique(_joined([p + salt for p in parts]) % np.uint64(bits))
            slot, first = np.unique(h >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))], ["slot", "mask"])
    return run


def frequent_bits(spark: SparkSession, level: DataFrame, k: int, max_bits: int = FILTER_BITS):
    """A broadcast bit table (bits, bytes) that holds the phrases of ``level``
    for sure and few others: 16 bits or more for each, ``max_bits`` at most.  The
    driver gets the table's 64-bit words, whose number is bounded by its size."""
    rows = level.where(F.col("w1") != "").select("lang", *(f"w{j + 1}" for j in range(k)))
    bits = min(max_bits, 1 << max(16, (16 * rows.count()).bit_length()))
    words = rows.mapInArrow(_bits_of(k, bits), "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["slot"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast((bits, table.view(np.uint8)))


def _in_step(max_words: int):
    """One pass over a stream: for each row the counts of the open phrases above
    it (null if they lie in an earlier part), and for each phrase, when it
    closes, the largest count one word below it.  A row without ``c`` is a boundary
    record: what this part found below a phrase of an earlier one."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = ["pid", "lang", *(f"w{j + 1}" for j in range(max_words)), "n", "c", *(f"h{j + 1}" for j in range(max_words - 1)), "ext"]
        types = [pa.int32(), *[pa.string()] * (max_words + 1), pa.int32(), *[pa.int64()] * (max_words + 1)]
        open_rows: list[list | None] = [None] * max_words  # by length - 1; None: in an earlier part
        made: list[list] = []

        def table():
            columns = [list(c) for c in zip(*made)]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def close(length: int):
            for j in range(length - 1, max_words):
                if open_rows[j] is not None:
                    made.append(open_rows[j])
                    open_rows[j] = None

        for batch in batches:
            for lang, *words, n, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                close(n)
                above = [open_rows[j] for j in range(n - 1)]
                if n > 1:
                    if above[-1] is None:  # a record for the phrase of an earlier part
                        key = [w if j < n - 1 else "" for j, w in enumerate(words)]
                        above[-1] = open_rows[n - 2] = [part, lang, *key, n - 1, None, *[None] * (max_words - 1), None]
                    above[-1][-1] = max(above[-1][-1] or 0, c)
                counts = [row and row[3 + max_words] for row in above]
                open_rows[n - 1] = [part, lang, *words, n, c, *counts, *[None] * (max_words - 1 - len(counts)), None]
                if len(made) >= 20_000:
                    yield table()
        close(1)
        if made:
            yield table()
    return run


def stream_counts(level_rows: DataFrame, order: str, max_words: int = MAX_WORDS, num_partitions: int | None = None) -> DataFrame:
    """The stream in ``order`` ('prefix' or 'suffix') passed through in step:
    lang, w1..wN, n, c, p1..p(N-1) (counts of the first or last parts of 1, 2, ...
    words) and ext (largest count of a phrase longer by one word at the other
    end; null without one)."""
    spark = level_rows.sparkSession
    words = [f"w{j + 1}" for j in range(max_words)]
    if order == "suffix":  # last word first, blanks behind
        turned = F.reverse(F.slice(F.array(*words), 1, F.col("n")))
        level_rows = level_rows.withColumn("_r", turned).select(
            "lang", *[F.coalesce(F.get("_r", F.lit(j)), F.lit("")).alias(w) for j, w in enumerate(words)], "n", "c")
    keys = [F.col(c) for c in ("lang", *words)]
    dealt = level_rows.repartitionByRange(num_partitions, *keys) if num_partitions else level_rows.repartitionByRange(*keys)
    schema = ("pid int, lang string, " + ", ".join(f"{w} string" for w in words) + ", n int, c long, "
              + ", ".join(f"h{j + 1} long" for j in range(max_words - 1)) + ", ext long")
    passed = stored(dealt.sortWithinPartitions(*keys).mapInArrow(_in_step(max_words), schema), f"{order}-stream")
    heads = [f"h{j + 1}" for j in range(max_words - 1)]
    # boundary: the open phrases at the end of each part; one row for a part
    last = passed.where(F.col("c").isNotNull()).groupBy("pid").agg(*[
        F.max_by(F.when(F.col("n") == j + 1, F.col("c")), F.when(F.col("n") == j + 1, F.struct(*keys))).alias(f"e{j + 1}")
        for j in range(max_words - 1)])
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = passed.select("pid").distinct().join(last, "pid", "left")
    carry = parts.select("pid", *[F.last(f"e{j + 1}", ignorenulls=True).over(before).alias(f"e{j + 1}") for j in range(max_words - 1)])
    below = passed.where(F.col("c").isNull()).groupBy("lang", *words).agg(F.max("ext").alias("_ext"))
    rows = passed.where(F.col("c").isNotNull()).join(F.broadcast(carry), "pid").join(below, ["lang", *words], "left")
    found = rows.select("lang", *words, "n", "c",
                        *[F.when(F.col("n") > j + 1, F.coalesce(h, F.col(f"e{j + 1}"))).alias(f"p{j + 1}") for j, h in enumerate(heads)],
                        F.greatest("ext", "_ext").alias("ext"))
    if order == "suffix":
        turned = F.reverse(F.slice(F.array(*words), 1, F.col("n")))
        found = found.withColumn("_r", turned).select(
            "lang", *[F.coalesce(F.get("_r", F.lit(j)), F.lit("")).alias(w) for j, w in enumerate(words)], "n", "c",
            *[f"p{j + 1}" for j in range(max_words - 1)], "ext")
    return found


def count_streams(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang",
                  text_col: str = "text", filter_bits: int = FILTER_BITS, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows lang, w1..wN, n, c of all frequent phrases; totals lang, n)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words, levels, known = [f"w{j + 1}" for j in range(max_words)], [], None
    for k in range(1, max_words + 1):
        level = stored(count_level(docs, k, known, min_count, batch_bytes), f"phrases-{k}")
        if k < max_words:
            known = frequent_bits(spark, level, k, filter_bits)
        levels.append(level.where(F.col("w1") != "").select(
            "lang", *[F.col(w) if j < k else F.lit("").alias(w) for j, w in enumerate(words)], F.lit(k).alias("n"), "c"))
        if k == 1:
            totals = level.where(F.col("w1") == "").select("lang", F.col("c").alias("total"))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    return rows, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 cover_percent: int = COVER_PERCENT, lang_col: str = "lang", text_col: str = "text",
                 filter_bits: int = FILTER_BITS, batch_bytes: int = BATCH_BYTES, num_partitions: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top``
    phrases of 2 to ``max_words`` words.  A phrase inside a longer one that has
    ``cover_percent`` of its count or more is left out; looking one word further is
    enough, as the parts of a phrase are at least as frequent."""
    rows, totals = count_streams(docs, min_count, max_words, lang_col, text_col, filter_bits, batch_bytes)
    words = [f"w{j + 1}" for j in range(max_words)]
    firsts = stream_counts(rows, "prefix", max_words, num_partitions).where(F.col("n") > 1)
    lasts = stream_counts(rows, "suffix", max_words, num_partitions).where(F.col("n") > 1).select(
        "lang", *words, *[F.col(f"p{j + 1}").alias(f"s{j + 1}") for j in range(max_words - 1)], F.col("ext").alias("ext_left"))
    found = firsts.hint("merge").join(lasts, ["lang", *words])
    found = found.where(F.coalesce(100 * F.greatest("ext", "ext_left") < cover_percent * F.col("c"), F.lit(True)))
    cuts = []
    for n in range(2, max_words + 1):
        for k in range(1, n):
            left, right = F.col(f"p{k}"), F.col(f"s{n - k}")
            score = F.expr(f"(1000000BD * cast(c as decimal(20,0)) * cast(c as decimal(20,0))) div "
                           f"(cast(p{k} as decimal(19,0)) * cast(s{n - k} as decimal(19,0)))")
            cuts.append(F.when(F.col("n") == n, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    best = found.select("lang", F.concat_ws(" ", *[F.nullif(F.col(w), F.lit("")) for w in words]).alias("phrase"),
                        F.col("c").alias("a"), F.array_min(F.array(*cuts)).alias("b"))
    best = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^ \x09]+') AS ws FROM docs
), words AS (
  SELECT lang, unnest(ws) AS w FROM pieces
), totals AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), uni AS (
  SELECT lang, w AS phrase, count(*) AS c FROM words GROUP BY lang, w
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM pieces
), bi AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS c FROM places GROUP BY ALL
), tri AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS c FROM places WHERE i + 2 <= len(ws) GROUP BY ALL
), covered AS (
  SELECT lang, w1, w2, max(c) AS longer FROM (
    SELECT lang, w1, w2, c FROM tri WHERE c >= 10 UNION ALL SELECT lang, w2, w3, c FROM tri WHERE c >= 10) GROUP BY lang, w1, w2
), cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.c AS a, 1 AS k, x.c AS l, y.c AS r
  FROM bi b JOIN uni x ON x.lang = b.lang AND x.phrase = b.w1 JOIN uni y ON y.lang = b.lang AND y.phrase = b.w2
  LEFT JOIN covered v ON v.lang = b.lang AND v.w1 = b.w1 AND v.w2 = b.w2
  WHERE b.c >= 10 AND (v.longer IS NULL OR 100 * v.longer < 50 * b.c)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.c, 1, x.c, y.c
  FROM tri t JOIN uni x ON x.lang = t.lang AND x.phrase = t.w1 JOIN bi y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  WHERE t.c >= 10
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.c, 2, x.c, y.c
  FROM tri t JOIN bi x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN uni y ON y.lang = t.lang AND y.phrase = t.w3
  WHERE t.c >= 10
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
