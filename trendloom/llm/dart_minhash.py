"""MinHash near-duplicates by DartMinHash signatures.

A document is the weighted set of its five-word shingles (words are runs of
``[0-9a-z]`` and non-ASCII after lower-casing A-Z; fewer than five words make one
shingle); weights are 1 or the shingle's count.  Each (shingle, unit of weight) is a
region on which hashed darts fall at rate 1 along the rank axis.  A
document throws the darts inside its weights slab by slab of rank, each slab
twice as long as all before it, until each of the ``k`` coordinates is hit (that
takes about ``k ln k + 2k`` darts), and each coordinate keeps its earliest dart.  Darts depend
on the shingle alone, so two documents agree in a coordinate with the
probability of their weighted Jaccard similarity, and a signature takes
time linear in the text plus the darts.

Signatures are cut into bands.  Documents with the same shingles are one
entry.  Each bucket (equal band) has a leader, by a hash of the bucket and the id, so an
entry meets other leaders in its other buckets; the pairs with a leader that reach
the similarity, by their whole shingle sets, are links, and linked entries form
components.  Pairs of a bucket that lie in different components are then
compared too, each once, so no link between bucket mates is lost, while a bucket
of copies costs one pair for each member and not their square.  Pairs are
compared in full only if the shingles that are not theirs alone could make a link, and
if their signatures (four bits of each coordinate) agree in as many
coordinates as a linked pair does but for one in 300,000 (the exact binomial
quantile).  With 32 bands of 5, a pair at similarity 0.8 shares no bucket with
the probability of 3.0e-6, so 54 of 160 may differ (tail 2.1e-6) and 5.1e-6 in all
are missed.  Before that last step each bucket gets a second leader, its
most central entry, which joins most of what belongs together.  Components are the classes.

Hot groups: copies are collapsed by aggregation below the shuffle, hot buckets
meet their one leader in joins that AQE may split, and no group is gathered in
one row.

Defined results: texts without words (null, empty, signs only) are alike only if
the texts are equal; the class id is the smallest id of the class; rows that
repeat an id each get the class of their own text, as entries are told apart by digest (two
classes whose smallest id is the same have the same class id); a row with a null id gets the
class of its text, which is null if no row with an id has it; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import free_name, stored, stored_bytes, text_key
from trendloom.llm.tokenizer_files import release_memos

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SKETCH_MISS = 1 / 300_000
BROADCAST_BYTES = 8 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from hashes."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    import xxhash
    words = WORD.findall((text or "").encode().lower())
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return h, np.zeros(0, np.int64)
    n = max(len(h) - size + 1, 1)
    total = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(min(size, len(words))):
        total = _mix(total * _ODD[i % 5] + h[i:i + n])
    return np.unique(total, return_counts=True)


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    top = int(mean + 12 * mean ** 0.5 + 24)
    logs = np.arange(top + 1) * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    return np.cumsum(np.exp(logs))


def _throw(cells: np.ndarray, cell: np.ndarray, weight: np.ndarray, slab: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, dart) of the darts of one rank slab inside the weights."""
    low, high = (0.0, 1.0) if slab == 0 else (2.0 ** (slab - 1), 2.0 ** slab)
    seed = _mix(cells + np.uint64(slab + 1 << 32))
    counts = np.searchsorted(_poisson(high - low), _unit(seed), side="right")
    owner = np.repeat(np.arange(len(cells)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    dart = _mix(seed[owner] + _ODD[6] * (nth.astype(np.uint64) + np.uint64(1)))
    inside = cell[owner] + _unit(_mix(dart + _ODD[0])) < weight[owner]
    dart = dart[inside]
    return low + (high - low) * _unit(_mix(dart + _ODD[1])), dart


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates; the set is not empty and
    its weights are positive."""
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    weight = weights.astype(np.float64)[owner]
    cells = _mix(elements[owner] + _ODD[2] * cell.astype(np.uint64))
    out, hit, slab = np.zeros(k, np.uint64), np.zeros(k, bool), 0
    while not hit.all():
        rank, dart = _throw(cells, cell, weight, slab)
        order = np.argsort(-rank, kind="stable")
        dart = dart[order]
        place = (_mix(dart + _ODD[3]) % np.uint64(k)).astype(np.int64)
        first = np.zeros(k, np.uint64)
        first[place] = dart  # of equal places the last, so the earliest rank, stays
        here = np.zeros(k, bool)
        here[place] = True
        out = np.where(hit, out, first)
        hit |= here
        slab += 1
    return out


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        total = _mix(total * _ODD[i % 5] + parts[:, i])
    return total.astype(np.int64)


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to a number."""
    low = np.zeros(-(-len(sig) // 16) * 16, np.uint64)
    low[:len(sig)] = _mix(sig) & np.uint64(15)
    return (low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def _most_differ(coordinates: int, similarity: float, miss: float = SKETCH_MISS) -> int:
    """The fewest coordinates which the sketches of a pair at the similarity exceed
    with a probability of at most ``miss``: the exact binomial quantile."""
    p = (1 - similarity) * 15 / 16
    tail, most = 0.0, coordinates
    while most > 0:
        tail += comb(coordinates, most) * p ** most * (1 - p) ** (coordinates - most)
        if tail > miss:
            break
        most -= 1
    return most


def _may_link(x: Column, y: Column, coordinates: int, similarity: float) -> Column:
    """Whether two sketches differ in as few coordinates as a linked pair's do."""
    differ = F.lit(0)
    for i in range(-(-coordinates // 16)):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= _most_differ(coordinates, similarity)


def _weighed(counts: np.ndarray, weight: str) -> np.ndarray:
    return counts.astype(np.float64) if weight == "count" else np.ones(len(counts))


def signatures(docs: DataFrame, weight: str = "presence", bands: int = BANDS, rows: int = ROWS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), digest (equal for equal weighted sets), n (shingles), bands and sketch."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        release_memos()
        for batch in batches:
            digests, sizes, keys, sketches = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                elements, counts = shingles(text)
                weights = _weighed(counts, weight)
                if len(elements):
                    content = b"w" + elements.tobytes() + weights.tobytes()
                    sig = signature(elements, weights, bands * rows)
                    keys.append(_bands(sig, bands, rows))
                    sketches.append(_sketch(sig))
                else:
                    content = b"t" + (text or "").encode()
                    keys.append(None)
                    sketches.append(None)
                digests.append(hashlib.blake2b(content, digest_size=16).digest())
                sizes.append(len(elements))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                                             ["doc_id", "key", "digest", "n", "bands", "sketch"])
    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), text_key(F.col(text_col)).alias("key"))
    return rows_.mapInArrow(run, "doc_id long, key long, digest binary, n int, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, weight: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the set (``s`` shingles, ``c`` weights where they differ from 1) of the documents in ``ids`` (id, doc_id, key)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        release_memos()
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.astype(np.int64) for s, _ in found], pa.list_(pa.int64())),
                 pa.array([c if weight == "count" else None for _, c in found], pa.list_(pa.int64()))], ["id", "s", "c"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    small = stored_bytes(ids) <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if small else ids, ["doc_id", "key"]).select("id", "t").mapInArrow(run, "id long, s array<long>, c array<long>")


def similar(pairs: DataFrame, sets: DataFrame, weight: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca"))
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    both = pairs.join(b, "b").join(a, "a")
    if weight == "count":
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x)
        of = lambda s, c: F.map_from_arrays(s, c)
        shared = F.aggregate("sa", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(
            F.least(F.element_at(of(F.col("sa"), F.col("ca")), x), F.element_at(of(F.col("sb"), F.col("cb")), x)), F.lit(0)))
        joint = total(F.col("ca")) + total(F.col("cb"))
    else:
        shared = F.size(F.array_intersect("sa", "sb"))
        joint = F.size("sa") + F.size("sb")
    return both.where(shared >= similarity * (joint - shared) - 1e-6).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the smallest id of
    its component.  Alternating large and small stars; each round is written
    and read again, and rounds end when the edges stay."""
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "u", "m")
        e = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (key, id, ...) with their roots, of the buckets that hold more than one component."""
    placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return placed.join(keys, "key")


def classes(docs: DataFrame, weight: str = "presence", similarity: float = SIMILARITY, bands: int = BANDS,
            rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id of every document."""
    return _classed(docs, weight, similarity, bands, rows, id_col, text_col).select("doc_id", "class_id")


def _classed(docs: DataFrame, weight: str = "presence", similarity: float = SIMILARITY, bands: int = BANDS,
             rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, class_id and first_key of every document: class_id and first_key
    are the doc_id and key of the first document of its class."""
    sigs = stored(signatures(docs, weight, bands, rows, id_col, text_col), "signatures")
    # one entry for each digest; its bands are equal in all copies
    entries = sigs.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.first("bands").alias("bands"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"))
    # named by a number of their own, as different texts may share an id
    entries = stored(entries.withColumn("id", F.monotonically_increasing_id()), "entries")
    buckets = entries.select("id", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("id", "key").alias("h"), "id")
    leaders = buckets.groupBy("key").agg(F.min(order).alias("lead"), F.min("id").alias("x"), F.max("id").alias("y"))
    leaders = leaders.where("x <> y").select("key", F.col("lead.id").alias("lead"))
    members = stored(buckets.join(leaders, "key"), "members")
    first = members.where("id <> lead").select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
    sketch = lambda name: entries.select(F.col("id").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    first = first.join(sketch("a"), "a").join(sketch("b"), "b").where(
        _may_link(F.col("a_sketch"), F.col("b_sketch"), bands * rows, similarity)).select("a", "b")
    first = stored(first, "pairs")
    ids = entries.select("id", "first.doc_id", "first.key").join(members.select("id").distinct(), "id", "left_semi")
    ids = stored(ids, "candidates")
    sets = stored(shingle_sets(docs, ids, weight, id_col, text_col), "sets")
    links = stored(similar(first, sets, weight, similarity), "links")
    roots = stored(components(links), "roots")
    # mates of a bucket that are not yet in one component
    placed = stored(_open(members.select("key", "id"), roots), "open-buckets")
    ids = placed.select("id").distinct()
    # shingles that no other mate has bound what a pair can share
    alone = (sets.join(ids, "id", "left_semi").select("id", F.explode("s").alias("e"))
             .groupBy("e").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
             .groupBy("id").agg(F.count("*").alias("own")))
    mates = placed.join(entries.select("id", "n", "bands", "sketch"), "id").join(alone, "id", "left")
    mates = stored(mates.withColumn("own", F.coalesce("own", F.lit(0))), "mates")

    def may_link(x: str, y: str) -> Column:
        """Different components, and neither counts nor sketches speak against a link."""
        col = lambda side, name: F.col(f"{side}.{name}")
        shared = F.least(col(x, "n") - col(x, "own"), col(y, "n") - col(y, "own"))  # at most
        sizes = shared * (1 + similarity) >= similarity * (col(x, "n") + col(y, "n")) - 1e-6
        return ((col(x, "root") != col(y, "root")) & (F.lit(True) if weight == "count" else sizes)
                & _may_link(col(x, "sketch"), col(y, "sketch"), bands * rows, similarity))

    # a second leader for each: the mate with the fewest shingles of its own
    core = mates.groupBy("key").agg(F.min(F.struct(
        "own", F.xxhash64("id", "key").alias("h"), "id", "n", "root", "sketch")).alias("y"))
    second = mates.alias("x").join(core, "key").where(may_link("x", "y")).select(
        F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    second = stored(second.join(first, ["a", "b"], "left_anti"), "second-pairs")
    links = stored(links.union(similar(second, sets, weight, similarity)), "links")
    roots = stored(components(links), "roots")
    # what is still open: every pair, in the first bucket that it shares
    mates = stored(_open(mates.drop("root"), roots), "open-mates")
    x, y = mates.alias("x"), mates.alias("y")
    once = F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands"))
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & may_link("x", "y") & once)
    across = across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    across = across.join(first.union(second), ["a", "b"], "left_anti")
    more = similar(stored(across, "cross-pairs"), sets, weight, similarity)
    roots = stored(components(links.union(more)), "roots")
    lows = entries.select("id", "first").join(roots, "id").groupBy("root").agg(F.min("first").alias("low"))
    lows = roots.join(lows, "root").select("id", "low")
    named = entries.join(lows, "id", "left").select("digest", F.coalesce("low", "first").alias("low"))
    return sigs.select("doc_id", "key", "digest").join(named, "digest", "left").select(
        "doc_id", "key", F.col("low.doc_id").alias("class_id"), F.col("low.key").alias("first_key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one document of each class: that whose id names
    it, once, and one text of it if ids repeat.  Rows with a null id stay, as no class can be named by them."""
    found = _classed(docs, id_col=id_col, text_col=text_col, **options).where("doc_id = class_id and key = first_key")
    kept = stored(found.groupBy(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key")).agg(
        F.count("*").alias("_rows")), "kept")
    small = stored_bytes(kept) <= BROADCAST_BYTES

    def only(ids: DataFrame) -> DataFrame:
        same = (docs[id_col] == ids["_kept_id"]) & (text_key(docs[text_col]) == ids["_kept_key"])
        return docs.join(F.broadcast(ids) if small else ids, same, "left_semi")

    rows = only(kept.where("_rows = 1"))
    repeated = kept.where("_rows > 1")
    if not repeated.isEmpty():
        key = free_name(docs, "text_key")
        again = only(repeated).withColumn(key, text_key(F.col(text_col)))
        rows = rows.union(again.dropDuplicates([id_col, key]).drop(key))
    return rows.union(docs.where(docs[id_col].isNull()))
