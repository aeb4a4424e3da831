"""Token counts, Elias-Fano output and the SentencePiece transducer against
the public libraries."""

import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_cases import by_row, edge_docs, edge_rows, empty_docs  # noqa: E402

from trendloom.llm import elias_fano, sp_transducer, token_counts  # noqa: E402
from trendloom.llm.tokenizer_files import PieceMemo, public_path  # noqa: E402
from trendloom.session import scratch_path  # noqa: E402

PARTS = ["a", "b", "'s", "'", " ", "  ", "\n", "\t", "é", "É", "İ", "ß", "<|endoftext|>", "<|", "ſ", "²", "1", "23", "!", "?!",
         "\x1c", "\x85", "\xa0", "日本", "ﬁ", "é", "Σ", "ΑΣ", "▁", "😀", "the", " the", "'T", "'re", "\x00", "Ａ", "​", "ing"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def library_ids(name, texts):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(public_path(name)).encode_batch(texts, add_special_tokens=False)
    return [np.asarray(e.ids, "<u4") for e in found]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_memo_equals_the_library(name):
    memo, texts = PieceMemo(public_path(name), pieces=50), fuzz(2000)
    assert [memo.encode(t) for t in texts] == [i.tobytes() for i in library_ids(name, texts)]


def test_token_counts_and_cache(spark):
    docs, cache = edge_docs(spark), scratch_path(spark, "cache")
    texts = [t or "" for _, t in edge_rows()]
    want = sorted(((i, len(t.encode()), len(ids), len(ids) > 512) for (i, _), t, ids in zip(
        edge_rows(), texts, library_ids("byte_bpe_50k.json", texts), strict=True)), key=repr)
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    half = docs.where("doc_id < 8")
    token_counts.count_tokens(half, cache).collect()
    first = spark.read.parquet(cache).count()
    assert first == half.selectExpr("coalesce(text, '') t").distinct().count()
    assert by_row(token_counts.count_tokens(docs, cache), *columns) == want
    assert spark.read.parquet(cache).count() == len(set(texts))  # only what was missing was added
    assert by_row(token_counts.count_tokens(docs, cache), *columns) == want
    assert spark.read.parquet(cache).count() == len(set(texts))
    model = by_row(token_counts.count_tokens(docs, cache, public_path("piece_bpe_32k.model")), "doc_id", "n_tokens")
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    assert model == sorted(((i, len(sp.encode(t or ""))) for i, t in edge_rows()), key=repr)
    assert token_counts.count_tokens(empty_docs(spark), scratch_path(spark, "cache")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 2, 900_000], list(range(1000)), [7] * 300 + [2 ** 40]])
def test_elias_fano_sequence(values):
    ef = elias_fano.EliasFano.build(np.array(values, np.int64), max(values, default=0))
    again = elias_fano.EliasFano(ef.n, ef.low_bits, ef.low, ef.high, ef.samples)
    assert again.values().tolist() == values
    assert [again.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        again.select(len(values))


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 4096))
    ef = elias_fano.EliasFano.build(ends, int(ends[-1]))
    assert 8 * (len(ef.low) + len(ef.high)) <= len(ends) * (3 + np.log2(ends[-1] / len(ends)))


@pytest.mark.parametrize("block_ids,block_docs", [(1 << 20, 4096), (50, 3), (1, 1)])
def test_token_ids_from_files(spark, block_ids, block_docs):
    path = scratch_path(spark, "ids")
    elias_fano.write_ids(edge_docs(spark), path, block_ids=block_ids, block_docs=block_docs)
    order = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [np.append(i, 1).astype("<u4") for i in library_ids("word_bpe_49k.json", [t or "" for _, t in order])]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]]).tolist()
    want = [(d, s, len(i), zlib.crc32(i.tobytes())) for (d, _), s, i in zip(order, starts, ids, strict=True)]
    got = by_row(elias_fano.read_documents(spark, path), "start", "doc_id", "n_tokens", "ids_crc32")
    assert sorted(got) == [(s, d, n, c) for d, s, n, c in want]
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in elias_fano.read_ids(spark, path).collect()))) == sorted(
        repr((d, i.tolist())) for (d, _), i in zip(order, ids, strict=True))


def test_token_ids_of_an_empty_table(spark):
    path = scratch_path(spark, "ids")
    elias_fano.write_ids(empty_docs(spark), path)
    assert elias_fano.read_documents(spark, path).count() == 0


def test_transducer_equals_the_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    fst, texts = sp_transducer.transducer(public_path("piece_bpe_32k.model")), fuzz(3000, 2)
    got = [fst.encode(t).tolist() for t in texts]
    assert got == sp.encode(texts)
    assert [fst.decode(i) for i in got] == sp.decode(got)
    assert [fst.decode(i) for i in got] == [t.replace("▁", " ") for t in texts]


def test_transducer_on_edge_cases(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    docs = edge_docs(spark)
    got = sp_transducer.round_trip(docs)
    assert got.where("not round_trip").count() == 0
    want = sorted(((i, len(x), zlib.crc32(np.asarray(x, "<i4").tobytes())) for i, x in (
        (i, sp.encode(t or "")) for i, t in edge_rows())), key=repr)
    assert by_row(got, "doc_id", "n_ids", "ids_crc32") == want
    assert sp_transducer.round_trip(empty_docs(spark)).count() == 0
    both = sp_transducer.decode(sp_transducer.encode(docs))
    assert sorted(map(repr, by_row(both, "doc_id", "decoded"))) == sorted(
        repr((i, (t or "").replace("▁", " "))) for i, t in edge_rows())
    assert by_row(both, "doc_id", "ids_crc32") == sorted(((i, c) for i, _, c in want), key=repr)
