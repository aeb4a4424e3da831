"""Collocations, conversation repair and packing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_cases import AZ, CLASHES, by_row, edge_docs, edge_rows, empty_docs, prose
from trendloom.llm import collocations, conversation_repair, packing
from trendloom.llm.common import read
from trendloom.llm.queries import QUERIES
from trendloom.llm.tokenizer_files import public_path

SMALL = "/root/testdata/sf0.001"


# collocations ---------------------------------------------------------------

def plain_collocations(rows, least, top, most=3, percent=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    found = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    longer = {}
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i:i + n]] = max(longer.get((lang, p[i:i + n]), 0), a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * longer.get((lang, p), -1) >= percent * a:
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(((lang, i, p.decode(), -a, lft, r, totals[lang], -s) for lang, v in out.items()
                   for i, (s, a, p, lft, r) in enumerate(sorted(v)[:top], 1)), key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def lang_docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice("the The of a b c été x1 no-go \x1c \x00".split(" ")) + rng.choice(["", "", "", ",", ". ", "\n"]) for _ in range(60)]
        rows.append((i, " ".join(words), rng.choice(["en", "en", "en", "fr", None, "und"])))
    rows += [(7, "a b\tc  a b c", "en")] * 12 + [(None, None, "en"), (None, "", None), (200, "only", "xx"), (201, "new york city " * 5000, "en")]
    return rows, spark.createDataFrame([(i, t, lang, *["x"] * 3) for i, t, lang in rows], "doc_id long, text string, lang string, w1 string, c string, n string")


@pytest.mark.parametrize("options", [{}, {"num_partitions": 7, "batch_bytes": 300}, {"filter_bits": 64, "num_partitions": 2}])
def test_collocations_equal_plain_counts(spark, options):
    rows, docs = lang_docs(spark)
    found = by_row(collocations.collocations(docs, 10, top=60, **options), *COLUMNS)
    assert found == plain_collocations([(lang, t) for _, t, lang in rows], 10, 60)
    assert len({r[0] for r in found}) >= 3


def test_collocations_of_four_words(spark):
    rows, docs = lang_docs(spark)
    found = by_row(collocations.collocations(docs, 5, max_words=4, top=300, cover_percent=80, num_partitions=5), *COLUMNS)
    assert found == plain_collocations([(lang, t) for _, t, lang in rows], 5, 300, most=4, percent=80)


def test_collocations_of_edge_rows_and_of_none(spark):
    found = by_row(collocations.collocations(edge_docs(spark), 10), *COLUMNS)
    assert found == plain_collocations([(None, t) for _, t in edge_rows()], 10, 2000) and found
    assert collocations.collocations(empty_docs(spark)).collect() == []


# conversation repair --------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """(conv, turn, role, text) after damage, and all conversations."""
    out, convs = [], set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, convs


def cheapest(symbols):
    """(cost, audit, [(index or None, role or None)]) by a forward DP over whole strings."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    given = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, rows) in list(best.items()):
                new = (cost + 2, audit + "I", [*rows, (None, names[given[s]])])
                if given[s] not in best or new[:2] < best[given[s]][:2]:
                    best[given[s]] = new
        return best

    best = {"": (0, "", [])}
    for i, (role, gone, truncated) in enumerate(symbols):
        best, new = inserted(best), {}
        for s, (cost, audit, rows) in best.items():
            options = [(s, (cost + 3, audit + "D", rows))]
            if not gone:
                options.append((given[s], (cost + 2 + truncated, audit + "R", [*rows, (i, names[given[s]])])))
                if role in after[s]:
                    options.append((after[s][role], (cost + truncated, audit + "K", [*rows, (i, None)])))
            for t, option in options:
                if t not in new or option[:2] < new[t][:2]:
                    new[t] = option
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def plain_audits(rows):
    damaged, convs = plain_damage(rows)
    out = []
    for conv in convs:
        mine = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        counts, symbols, seen = Counter(), [], set()
        for _, role, text in mine:
            bare = text.strip(SPACES)
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[kind] += 1
            symbols.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, repaired = cheapest(symbols)
        text = "\n".join(f"{role or mine[i][1]}:{'' if i is None else mine[i][2]}" for i, role in repaired)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


AUDIT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
CONVERSATION = "conv_id long, turn long, role string, text string, conv string, part string, audit string, present string, flag string"


def conversation_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No", "", "  ", "ok!", "a. \x0b", "été?", "word\x1c", None, "Well"]
    rows = [(c, None if rng.random() < 0.05 else rng.randrange(12), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))
            for c in [*range(40), None] for _ in range(rng.randrange(1, 9))]
    rows += [(1000, t, rng.choice(["user", "assistant", "system"]), rng.choice([*texts, f"t{t}.", f"t{t}", f"u{t}!"])) for t in range(300)]
    rows += [(1001, 5, "user", "same.")] * 50 + [(1002, t, "assistant", "ok.") for t in range(60)]
    rows += [(1003, 1, "user", "x" * 100_000 + "."), (1003, 2, "assistant", "y" * 100_000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3, "num_partitions": 9}, {"chunk_bytes": 20, "num_partitions": 3}, {"num_partitions": 1}])
def test_repair_equals_plain_dynamic_programming(spark, options):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], CONVERSATION).repartition(4)
    found = by_row(conversation_repair.audits(conversation_repair.damaged(frame), **options), *AUDIT)
    assert found == plain_audits(rows)


def test_repair_of_none(spark):
    frame = spark.createDataFrame([], CONVERSATION)
    assert conversation_repair.audits(conversation_repair.damaged(frame)).collect() == []


def test_block_tables_equal_single_steps():
    rng = random.Random(1)
    for block in (1, 2, 4):
        t = conversation_repair.Tables(block)
        for n in (0, 1, 5, 40):
            symbols = conversation_repair.np.array([rng.randrange(9) for _ in range(n)], dtype=int)
            names = [("sua "[s % 4] if s < 8 else "u", s == 8, 4 <= s < 8) for s in symbols.tolist()]
            assert t.trace(symbols, t.end, conversation_repair.START, True)[0] == cheapest(names)[1]


def test_repaired_rows_read_as_they_should(spark):
    frame = spark.createDataFrame([r for r in conversation_rows() if r[0] is not None], "conv_id long, turn long, role string, text string")
    parts = conversation_repair.repair(frame, chunk_rows=5, num_partitions=4).collect()
    said = {}
    for r in sorted(parts, key=lambda r: (r["part"], r["seq"])):
        said[r["conv_id"]] = said.get(r["conv_id"], "") + "".join(x[:1] for x in r["roles"])
    assert all(re.fullmatch("(s?(ua)+)?", s) for s in said.values()) and len(said) > 40


def test_repair_query_equals_plain(spark):
    rows = [tuple(r) for r in read(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert by_row(QUERIES["op12_conversation_repair"](spark, SMALL), *AUDIT) == plain_audits(rows)


# packing --------------------------------------------------------------------

PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def held(pieces, rows, window, end_id=2):
    """The pieces tile the sequences and the documents, with the library's ids."""
    import numpy as np
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    texts = {}
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4")
        texts.setdefault(i, []).append(ids)
    docs, sequences = {}, {}
    for doc, start, length, crc, tokens, sequence, offset in pieces:
        assert length > 0 and tokens in {len(x) for x in texts[doc]}
        assert any(len(x) == tokens and zlib.crc32(x[start:start + length].tobytes()) == crc for x in texts[doc])
        docs[doc] = docs.get(doc, 0) + length
        sequences.setdefault(sequence, []).append((offset, length))
    assert docs == {i: sum(map(len, x)) for i, x in texts.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    total = sum(docs.values())
    assert sorted(sequences) == list(range(-(-total // window)))
    sizes = [sum(n for _, n in sequences[s]) for s in sorted(sequences)]
    assert sizes[:-1] == [window] * (len(sizes) - 1) and sizes[-1] == (total - 1) % window + 1


@pytest.mark.parametrize("options", [{}, {"window": 64, "run_docs": 3}, {"window": 7, "run_ids": 1, "broadcast_parts": 0}])
def test_packed_pieces_tile_the_documents(spark, options):
    sequences = packing.pack(edge_docs(spark), **options)
    held(by_row(packing.piece_rows(sequences), *PIECES), edge_rows(), options.get("window", 4096))
    for r in sequences.collect():
        n, window = r["n_ids"], options.get("window", 4096)
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else window)


def test_packing_of_none(spark):
    assert packing.pack(empty_docs(spark)).collect() == []


def test_packing_query_over_its_table(spark):
    rows = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    held(by_row(QUERIES["op13_packing"](spark, SMALL), *PIECES), rows, 4096)


def test_collocations_query_against_plain(spark):
    rows = [tuple(r) for r in read(spark, SMALL, "documents").select("lang", "text").collect()]
    assert by_row(QUERIES["op11_collocations"](spark, SMALL), *COLUMNS) == plain_collocations(rows, 10, 2000)


def test_clash_list_is_used():
    assert "words" in CLASHES and F is not None and prose(1, 1)
