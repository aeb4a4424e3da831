"""Quality rules, license scan and decontamination: against DuckDB on the
smallest tables and against plain Python on the edge cases."""

import hashlib
import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_cases import by_row, edge_docs, edge_rows, empty_docs, plain, prose, spaced  # noqa: E402

from trendloom.llm import decontaminate, license_scan, quality_rules  # noqa: E402
from trendloom.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def _cells(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(None if pd.isna(v) else (round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v)
                         for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _cells(got.astype(object)) == _cells(want.astype(object))


def _repeat_words(words):
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(3))
    return len(hit)


def _judged(doc_id, text):
    t, words = text or "", spaced(text)
    lines = [x for x in t.split("\n") if spaced(x)]
    dup, repeat = len(lines) - len(set(lines)), _repeat_words(words)
    symbols = sum(c in "#*$%&|<>" for c in t)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    upper = sum("A" <= c <= "Z" for c in t)
    kept = not (failed or symbols > len(words) or 2 * upper > len(t) or 2 * dup > len(lines)
                or sum(map(len, words)) > 25 * len(words) or 20 * len(set(words)) < len(words) - 2000)
    return doc_id, len(words), sum(map(len, words)), symbols, dup, repeat, failed, kept


def test_quality_rules_on_edge_cases(spark):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = by_row(quality_rules.judge(edge_docs(spark)), *columns)
    assert got == sorted((_judged(i, t) for i, t in edge_rows()), key=repr)
    assert quality_rules.judge(empty_docs(spark)).count() == 0


def test_cascade_keeps_the_same_documents_in_any_order(spark):
    docs = edge_docs(spark)
    want = sorted(repr((i, t)) for i, t in edge_rows() if _judged(i, t)[-1])
    rules = quality_rules.base_rules() + quality_rules.further_rules()
    for order in (rules, rules[::-1]):
        from pyspark.sql import functions as F
        from trendloom.llm.common import spaced_words
        mask = quality_rules.verdict(order, F.col("text"), spaced_words(F.col("text")))
        assert sorted(repr((r["doc_id"], r["text"])) for r in docs.where(mask).collect()) == want
    kept = docs.where(quality_rules.keep_mask(docs))
    assert kept.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == want


def test_rules_are_ordered_by_rejections_per_second():
    rules = [quality_rules.Rule(n, None) for n in "abc"]
    order = quality_rules.order_rules(rules, {"a": (0.1, 1.0), "b": (0.1, 0.1), "c": (0.0, 0.01)})
    assert [r.name for r in order] == ["b", "a", "c"]


def _contaminated(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = plain(text)
        for i in range(max(len(w) - size + 1, 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, ids = plain(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, prose(2, 30)), (2, None), (3, ""), (10, prose(2, 30)), (4, "one two"), (None, "one"), (5, prose(5, 12).upper()),
         (6, "a b c a b c a b c a b c")]


@pytest.mark.parametrize("limit", [1 << 30, -1])
def test_decontamination_on_edge_cases(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(edge_docs(spark), items, broadcast_bytes=limit)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(got, *columns) == _contaminated(edge_rows(), ITEMS)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty_docs(spark), items).count() == 0
    none = decontaminate.contamination(edge_docs(spark), items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(edge_rows())


def _scanned(doc_id, text):
    w = plain(text)
    places, base = [], set()
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    for line in (text or "").split("\n"):
        b = set(plain(line))
        for label, t in license_scan.TEMPLATES:
            tokens = set(t.split())
            if len(tokens & b) >= license_scan._need(len(tokens), license_scan.THRESHOLD):
                labels.add(label)
                score = max(score, len(tokens & b) / len(tokens))
    return (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(score, 9))


def test_license_scan_on_edge_cases(spark):
    more = [(20, "under the MIT\nlicense, under the mit license"), (21, "cc by nc cc by nc"),
            (22, "you may not use THIS file except in\tcompliance with license"), (23, "Licensed under the GNU General Public License, version 3"),
            (24, "apache license version 2 " * 50 + "x"), (25, "under the Kit license")]
    docs = edge_docs(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = sorted(((*r[:-1], round(r[-1], 9)) for r in by_row(license_scan.scan(docs), *columns)), key=repr)
    assert got == sorted((_scanned(i, t) for i, t in edge_rows() + more), key=repr)
    assert by_row(license_scan.scan(edge_docs(spark)), "doc_id", "labels") == sorted(
        ((r[0], r[6]) for r in (_scanned(i, t) for i, t in edge_rows())), key=repr)
    assert license_scan.scan(empty_docs(spark)).count() == 0
