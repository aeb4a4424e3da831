"""Token ids as binary: one array of ids with Elias-Fano document boundaries.

The output is a Parquet table of blocks.  A block holds the ids of consecutive
documents (ascending by id) as one little-endian array, 16 bits wide if the
vocabulary allows and else 32, and the ends of its documents as an Elias-Fano
sequence: of ``n`` ascending numbers up to ``u`` the low ``log2(u / n)`` bits are
packed, and the rest is a bit vector with the i-th one at ``(value >> low) + i``.
That is at most ``2 + log2(u / n)`` bits for a document.  The place of every
64th one is kept, so ``select`` finds the end of one document without
unpacking the rest.

Documents are dealt by range of their ids and sorted inside each part; a part is
cut into blocks of bounded size, but a document is never cut.  Spark's committer
writes the files, so a lost executor leaves neither gaps nor doubles.

Defined results: null and empty texts have the end id alone; a null id comes
first; documents that repeat an id are all kept, one after the other (by text);
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.tokenizer_files import in_slices, memo_of, public_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 20
BLOCK_DOCS = 4096
SAMPLE = 64
BLOCK_SCHEMA = ("part int, seq int, n_docs int, n_ids long, width int, doc_ids array<long>, "
                "low_bits int, low binary, high binary, samples binary, ids binary")
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A non-descending sequence of numbers in ``0..universe``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(n + (universe >> low_bits) + 1, dtype=np.uint8)
        high[places] = 1
        pack = lambda bits: np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
        return cls(n, low_bits, pack(low.ravel()), pack(high), places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at // 8:(at + self.low_bits) // 8 + 1], "little")
        return (word >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sampled one onwards."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        here = self.high[byte] >> (place % 8) << (place % 8)
        while left >= _ONES[here]:
            left -= int(_ONES[here])
            byte += 1
            here = self.high[byte]
        for _ in range(left):
            here &= here - 1
        place = byte * 8 + (here & -here).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (places - np.arange(self.n)) << self.low_bits | low


def _packer(path: str, end_id: int | None, width: int, block_ids: int, block_docs: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        memo, part = memo_of(path), TaskContext.get().partitionId()
        kind = "<u2" if width == 16 else "<u4"
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                            ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("low_bits", pa.int32()),
                            ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()), ("ids", pa.binary())])
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        docs, chunks, sizes, held, seq = [], [], [], 0, 0

        def block():
            ends = np.cumsum(sizes)
            ef = EliasFano.build(ends, int(ends[-1]))
            row = (part, seq, len(docs), int(ends[-1]), width, docs, ef.low_bits, ef.low, ef.high, ef.samples,
                   b"".join(chunks))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            found = chain.from_iterable(map(memo.encode_all, in_slices(batch.column(1))))
            for doc, encoded in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = np.frombuffer(encoded + tail, "<u4")
                docs.append(doc)
                sizes.append(len(ids))
                chunks.append(ids.astype(kind).tobytes())
                held += len(ids)
                if len(docs) >= block_docs or held >= block_ids:
                    yield block()
                    docs, chunks, sizes, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield block()
    return run


def write_ids(docs: DataFrame, out_path: str, path: str | None = None, end_id: int | None = END_ID,
              id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS,
              block_docs: int = BLOCK_DOCS) -> None:
    """Encode every text and write the blocks in ascending order of the ids."""
    path = path or public_path(TOKENIZER)
    from tokenizers import Tokenizer
    width = 16 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id or 0) < 1 << 16 else 32
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")
    ordered.mapInArrow(_packer(path, end_id, width, block_ids, block_docs), BLOCK_SCHEMA).write.parquet(out_path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, seq, base): how many ids stand before each block.  The window
    without a key runs over one row for each written part."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(
        parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).cast("long").alias("base"))


def _reader(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        for row in batch.to_pylist():
            ef = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
            ends = ef.values()
            ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 16 else "<u4").astype("<u4")
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            n = row["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_documents(spark, out_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(out_path)
    docs = blocks.mapInArrow(_reader, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(block_starts(blocks.select("part", "seq", "n_ids")), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark, out_path: str) -> DataFrame:
    """doc_id and ids of every document, from the files."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"]).values()
                ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 16 else "<u4").astype(np.int64)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()),
                                                  pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])
    return spark.read.schema(BLOCK_SCHEMA).parquet(out_path).mapInArrow(run, "doc_id long, ids array<long>")
