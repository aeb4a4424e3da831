"""Packing by concatenate and cut.

The texts are encoded where they lie, in the order of the input's parts, and
written as runs: the ids of consecutive documents of one part, with their
sizes.  Two passes of prefix sums - over the runs of a part, and over the totals of
the parts - give the place of every run in the concatenation of all documents.
Then each run is cut at the multiples of the window.  A window that lies inside a run is
a finished sequence; the pieces at a run's two ends are boundary records, which meet
their neighbours by sequence in one small shuffle.  No text is shuffled and no
key exists, so nothing is skewed.  Only the last sequence can be short; it is padded
unless its length is a power of two.

Runs and sequences are Parquet tables in the shared folder, written by Spark's
committer, so a lost task leaves neither gaps nor doubles, and a run's place is
read from what was written.

Defined results: null and empty texts have the end id alone; null ids, ids that
repeat and repeated rows are all packed, each for itself; an empty table gives no
sequence; other columns are not read.  Documents follow the input's parts, not their
ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import stored
from trendloom.llm.tokenizer_files import in_slices, memo_of, public_path, release_memos

TOKENIZER = "word_bpe_49k.json"
END_ID, PAD_ID, WINDOW = 2, 0, 4096
RUN_IDS, RUN_DOCS = 1 << 17, 8192
#: Pieces that a worker remembers, twice; less than elsewhere, as the runs are written beside them.
MEMO_PIECES = 200_000
#: One row for each part of the input is broadcast up to here, and joined by shuffle beyond.
BROADCAST_PARTS = 1 << 18
RUN_SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, sizes array<int>, width int, ids binary"
PIECE = "array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint>>"
SEQUENCE_SCHEMA = f"sequence_id long, n_ids int, pieces {PIECE}, ids binary"


def _encoder(path: str, end_id: int, run_ids: int, run_docs: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        memo, part, end = memo_of(path, MEMO_PIECES), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        docs, chunks, sizes, held, seq = [], [], [], 0, 0

        def row():
            ids = np.frombuffer(b"".join(chunks), "<u4")
            width = 16 if ids.max() < 1 << 16 else 32
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([width], pa.int32()), pa.array([ids.astype(f"<u{width // 8}").tobytes()], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "sizes", "width", "ids"])

        for batch in batches:
            found = chain.from_iterable(map(memo.encode_all, in_slices(batch.column(1))))
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                docs.append(doc)
                chunks += (ids, end)
                sizes.append(len(ids) // 4 + 1)
                held += sizes[-1]
                if held >= run_ids or len(docs) >= run_docs:
                    yield row()
                    docs, chunks, sizes, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield row()
    return run


def encode_runs(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                run_ids: int = RUN_IDS, run_docs: int = RUN_DOCS) -> DataFrame:
    """The written runs of all texts, each text followed by ``end_id``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return stored(rows.mapInArrow(_encoder(path or public_path(TOKENIZER), end_id, run_ids, run_docs), RUN_SCHEMA), "runs")


def run_starts(runs: DataFrame) -> DataFrame:
    """(part, seq, base): how many ids stand before each run.  The window without
    a key runs over one row for each part."""
    parts = runs.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(
        parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).cast("long").alias("base"))


def _pieces(doc_ids: list, sizes: list, base: int, window: int):
    """Columns of the pieces of a run's documents, in order: document, start,
    length, tokens of the document, sequence, offset, and place in the run."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    first, last = (base + starts) // window, (base + starts + sizes - 1) // window
    n = last - first + 1
    doc = np.repeat(np.arange(len(sizes)), n)
    sequence = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    left = np.maximum(base + starts[doc], sequence * window)
    right = np.minimum(base + starts[doc] + sizes[doc], (sequence + 1) * window)
    return (doc, left - base - starts[doc], right - left, sizes[doc], sequence, left - sequence * window, left - base)


def _cutter(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        release_memos()  # of the workers that encoded before
        for batch in batches:
            for row in (r for lo in range(batch.num_rows) for r in batch.slice(lo, 1).to_pylist()):
                doc, start, length, tokens, sequence, offset, place = _pieces(row["doc_ids"], row["sizes"], row["base"], window)
                cuts = np.flatnonzero(np.diff(sequence, prepend=-1))
                ends = np.append(cuts[1:], len(sequence))
                pieces = pa.StructArray.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc)), *map(pa.array, (start, length, tokens, offset))],
                    ["doc_id", "start", "length", "doc_tokens", "offset"])
                a, b = place[cuts], place[ends - 1] + length[ends - 1]
                ids = np.frombuffer(row["ids"], f"<u{row['width'] // 8}").astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sequence[cuts]), pa.array((b - a).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.append(cuts, len(sequence)).astype(np.int32)), pieces),
                     pa.array([ids[4 * i:4 * j] for i, j in zip(a.tolist(), b.tolist())], pa.binary())],
                    ["sequence_id", "n_ids", "pieces", "ids"])
    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, pad_id: int = PAD_ID,
         id_col: str = "doc_id", text_col: str = "text", run_ids: int = RUN_IDS, run_docs: int = RUN_DOCS,
         broadcast_parts: int = BROADCAST_PARTS) -> DataFrame:
    """The packed sequences, written and read again: sequence_id, n_ids (without
    padding), pieces (doc_id, start in the document, length, doc_tokens, offset in
    the sequence) and ids (little-endian unsigned 32-bit, padded)."""
    runs = encode_runs(docs, path, end_id, id_col, text_col, run_ids, run_docs)
    bases = stored(run_starts(runs.select("part", "seq", "n_ids")), "run-starts")
    if bases.count() <= broadcast_parts:
        bases = F.broadcast(bases)
    cut = stored(runs.join(bases, ["part", "seq"]).select("doc_ids", "sizes", "width", "ids", "base").mapInArrow(
        _cutter(window), SEQUENCE_SCHEMA), "cuts")
    whole = cut.where(F.col("n_ids") == window)
    # boundary records: two for a run at most, and as many for a sequence as it has ids at most
    ends = cut.where(F.col("n_ids") < window).groupBy("sequence_id").agg(
        F.sum("n_ids").cast("int").alias("n_ids"), F.array_sort(F.collect_list(F.struct(F.col("pieces")[0]["offset"].alias("at"), "pieces", "ids"))).alias("e"))
    ids = F.aggregate(F.col("e"), F.lit(b""), lambda got, x: F.concat(got, x["ids"]))
    short = (F.col("n_ids") < window) & (F.bit_count(F.col("n_ids").cast("long")) > 1)
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit(window) - F.col("n_ids")))
    ends = ends.select("sequence_id", "n_ids", F.flatten(F.col("e.pieces")).alias("pieces"),
                       F.when(short, F.concat(ids, pad)).otherwise(ids).alias("ids"))
    return whole.unionByName(ends)


def piece_rows(sequences: DataFrame) -> DataFrame:
    """One row for each piece of the sequences, with the crc32 of its ids."""
    def row(p):
        crc = F.crc32(F.substring(F.col("ids"), (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int")))
        return F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), crc.alias("ids_crc32"),
                        p["doc_tokens"].alias("doc_tokens"), F.col("sequence_id").alias("sequence_id"), p["offset"].alias("offset"))
    return sequences.select(F.inline(F.transform("pieces", row)))
