"""LM score, quality and toxicity classifiers, near-duplicates and the
pipeline: against plain versions and held-out labels."""

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_cases import AZ, SCHEMA, by_row, edge_docs, edge_rows, empty_docs, plain, prose, spaced  # noqa: E402

from trendloom.llm import context_mixing, dart_minhash, factorization, toxicity  # noqa: E402
from trendloom.llm.common import read  # noqa: E402

SF, SF_LABELS = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % m


# ------------------------------------------------------------------ LM score

def _base(rows):
    tokens = [[w.translate(AZ) for w in spaced(t)] + [None] for _, t in rows]
    training = [crc(i, 10) != 0 for i, _ in rows]
    c = Counter(w for t, use in zip(tokens, training, strict=True) if use for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, not use, len(t), sum(c[w] > 0 for w in t), n,
                    round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))
                   for (i, _), t, use in zip(rows, tokens, training, strict=True)), key=repr)


def _scored(df):
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    return sorted(((*r[:-1], round(r[-1], 6)) for r in by_row(df, *columns)), key=repr)


def test_base_score_on_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "FREQUENT", 20)  # most words take the shuffle join
    monkeypatch.setattr(context_mixing, "COMMON", 30)
    got = context_mixing.score(edge_docs(spark))
    assert _scored(got) == _base(edge_rows())
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got.collect())
    assert context_mixing.score(empty_docs(spark)).count() == 0


def test_lm_score_beats_the_base_on_held_out_text(spark):
    got = context_mixing.score(read(spark, SF, "documents")).where("held_out").agg(
        {"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first().asDict()
    assert got["sum(score)"] > 1.05 * got["sum(base_score)"]  # near the base, which gives unseen words too much


def test_lm_weights_learn_within_a_short_document(spark):
    """The weights change also within a text of fewer than 512 words."""
    texts = [(i, prose(i, 60)) for i in range(200)] + [(1000 + k, "zqx " * 33 * k) for k in (1, 2, 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in context_mixing.score(docs).where("doc_id >= 1000").collect()}
    # without learning the same words cost the same each time
    assert abs((got[1003] - got[1002]) - (got[1002] - got[1001])) > 1e-3


def test_lm_score_sees_the_word_before(spark):
    """Words in the order of the training texts cost less than the same words in another, also in a text of fewer than
    32 words, all of which are scored by the same weights."""
    import random
    names = [f"w{chr(97 + i)}{chr(97 + 7 * i % 26)}" for i in range(24)]
    held = [i for i in range(2000, 2400) if crc(i, 10) == 0][:2]
    texts = []
    for i in range(300):  # each word is followed by one of two
        at, words = i % 24, []
        for k in range(20):
            words.append(names[at])
            at = (at * 5 + 1 + (i + k) % 2) % 24
        texts.append((i, " ".join(words)))
    words = texts[5][1].split()
    mixed = random.Random(1).sample(words, len(words))
    docs = spark.createDataFrame([*texts, (held[0], " ".join(words)), (held[1], " ".join(mixed))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_mixing.score(docs).where("doc_id >= 2000").collect()}
    assert all(got[i]["held_out"] for i in held)
    assert got[held[0]]["score"] > got[held[1]]["score"] + 5


def test_words_before_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "FEW_BEFORE", 2)  # most words' rows are dealt
    texts = [*edge_rows(), *[(i, prose(i, 40)) for i in range(30)], (3, "café noir"), (3, "a a a a")]
    want = Counter()
    for i, t in texts:
        raw = (t or "").encode().lower()
        words = [*context_mixing.WORD.findall(raw), b""]
        if crc(i, 10):
            want.update((context_mixing.text_class(raw), w.decode(), zlib.crc32(b)) for b, w in zip([b"", *words], words))
    got = Counter()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for r in context_mixing.word_pairs(docs, "doc_id", "text").collect():
        for b, n in zip(*(np.frombuffer(bytes(r[c]), np.uint32).tolist() for c in ("before", "uses")), strict=True):
            got[r["class"], r["word"], b] += n
    assert got == want


def test_pair_slots_against_plain_sums(spark):
    """The slots of the pairs hold the zeros and ones after each word before, and each Newton step
    is that of a plain sum over all decisions of all pairs."""
    texts = [(i, prose(i, 12)) for i in range(1, 12) if crc(i, 10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    m, sent = context_mixing, {}
    fit = m.first_weights

    def kept(pairs, codes, table, pair_table, totals, steps=1):
        sent.update(pairs=pairs.collect(), codes=codes, table=table, pair_table=pair_table, totals=totals)
        return fit(pairs, codes, table, pair_table, totals, 1)

    m.first_weights = kept
    try:
        weights = m.train(docs)[0].weights
    finally:
        m.first_weights = fit
    want, g, h = np.zeros((2, 1 << m.PAIR_BITS)), np.zeros((m.GATES, m.K)), np.zeros((m.GATES, m.K, m.K))
    for r in sent["pairs"]:
        c = m.coded(m._symbols([r["word"]]), np.array([r["class"]]), sent["codes"])
        prefix = m.prefix_counts(np.array(r["path"]), np.array([len(r["path"])]), np.array([r["class"]]), c, sent["totals"])
        for b, n in zip(*(np.frombuffer(bytes(r[k]), np.uint32).tolist() for k in ("before", "uses")), strict=True):
            slot = m.pair_slots(c.deep, np.full(len(c.deep), b, np.uint32))
            for d, bit in enumerate(c.bits.tolist()):
                want[bit, slot[d]] += n
                counts = [[*sent["table"][v][c.slots[:, d]], prefix[v][d], sent["pair_table"][v][slot[d]]] for v in (0, 1)]
                counts = np.maximum(np.array(counts) - np.array([[bit == 0], [bit == 1]]), 0)
                x = np.log((counts[1] + m.PRIOR) / (counts[0] + m.PRIOR))
                i = m.gates(c.place[d], counts[:, -2].sum())
                p = 1 / (1 + np.exp(-x.sum() / m.K))
                g[i] += n * (p - bit) * x
                h[i] += n * p * (1 - p) * np.outer(x, x)
    assert (want == sent["pair_table"]).all()
    step = np.linalg.solve(h + m.RIDGE * np.eye(m.K), g[..., None])[..., 0]
    assert np.allclose(weights, 1 / m.K - np.clip(step, -1, 1), atol=1e-3)


def test_lm_score_is_above_the_base_on_held_out_text(spark):
    got = context_mixing.score(read(spark, SF_LABELS, "documents")).where("held_out").agg(
        {"score": "sum", "base_score": "sum"}).first().asDict()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_lm_score_knows_all_words_whatever_is_broadcast(spark, monkeypatch):
    """Rare words have the same exact prefix counts by the shuffle as by the broadcast."""
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(
        edge_docs(spark).select("doc_id", "text").where("doc_id is null or doc_id <> 5"))
    want = {(r["doc_id"], r["n_bytes"]): r["score"] for r in context_mixing.score(docs).collect()}
    monkeypatch.setattr(context_mixing, "COMMON", 50)
    monkeypatch.setattr(context_mixing, "CHUNK", 64)  # most prefixes lie in several chunks
    got = {(r["doc_id"], r["n_bytes"]): r["score"] for r in context_mixing.score(docs).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-4 * abs(want[k]) for k in want)


def test_prefix_counts_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "CHUNK", 7)
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(150)} | {""})
    rows = [(k, w, int(rng.integers(0, 5))) for k in (0, 3) for w in words]
    codes = context_mixing.code_table(np.arange(256) ** 2)
    totals = np.bincount([k for k, _, _ in rows], [n for _, _, n in rows], context_mixing.CLASSES).astype(np.int64)
    got = context_mixing.prefix_paths(spark.createDataFrame(rows, "class int, word string, n long"), codes).collect()
    assert sorted((r["class"], r["word"], r["n"]) for r in got) == sorted(rows)
    symbols = context_mixing._symbols
    for r in got:
        word, path = symbols([r["word"]])[0], np.array(r["path"], np.int64)
        c = context_mixing.coded([word], np.array([r["class"]]), codes)
        zeros, ones = context_mixing.prefix_counts(path, np.array([len(path)]), np.array([r["class"]]), c, totals)
        at = 0
        for i, b in enumerate(word):
            for j in range(int(codes[0][b])):
                want = [0, 0]
                for k, w, n in rows:
                    v = symbols([w])[0]
                    if k == r["class"] and v[:i] == word[:i] and len(v) > i and codes[0][v[i]] > j and (
                            codes[2][v[i]][:j + 1] == codes[2][b][:j + 1]).all():
                        want[codes[1][v[i]][j]] += n
                assert (zeros[at], ones[at]) == tuple(want)
                at += 1


def test_lm_score_disk_stays_in_proportion(tmp_path):
    """Shuffle files and stored tables never take more than eight times a small input at once, whose words
    are many for its size."""
    import subprocess
    import time
    path = os.path.join(SF_LABELS, "documents.parquet")
    code = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "3g").config("spark.local.dir", "{tmp_path}/local").config("spark.checkpoint.dir", "{tmp_path}/shared")
         .config("spark.sql.warehouse.dir", "{tmp_path}/warehouse").getOrCreate())
from trendloom.llm import context_mixing
assert context_mixing.score(spark.read.parquet("{path}")).where("score < 0").count() > 0
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.Popen([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, cwd=tmp_path)
    most = 0
    while run.poll() is None:
        used = 0
        for folder, _, names in os.walk(tmp_path):
            for name in names:
                try:
                    used += os.path.getsize(os.path.join(folder, name))
                except OSError:  # just deleted
                    pass
        most = max(most, used)
        time.sleep(0.05)
    assert run.returncode == 0
    assert most < 8 * os.path.getsize(path), most


def test_varints_and_packed_words():
    values = np.array([0, 1, 127, 128, 300, 2 ** 35, 2 ** 62, 5])
    raw, sizes = context_mixing.varints(values)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 6, 9, 1]
    assert context_mixing.from_varints(raw.tobytes()).tolist() == values.tolist()
    assert context_mixing.from_varints(b"").tolist() == []
    for words in ([b""], [b"", b"a"], [b"a", "é".encode(), b"b"]):
        assert context_mixing._split(context_mixing._joined(words)) == words


def test_word_probabilities_sum_to_one():
    """Over all symbols of one byte after any prefix, the decisions' probabilities sum to 1."""
    codes = context_mixing.code_table(np.arange(256) ** 2)
    rng = np.random.default_rng(1)
    words = [b"pre" + bytes([b]) for b in range(256)]
    c = context_mixing.coded(words, np.zeros(256, np.int64), codes)
    inputs = rng.normal(0, 2, context_mixing.OFFSETS[-1]).astype(np.float32)
    z = inputs[c.slots].sum(0)
    log = -np.logaddexp(0, np.where(c.bits == 1, -z, z).astype(np.float64))
    last = [log[a + len(codes[1][0]) * 0:b] for a, b in zip(c.starts[:-1], c.starts[1:], strict=True)]
    lengths = codes[0]
    head = sum(lengths[b] for b in b"pre")
    assert abs(sum(math.exp(x[head:].sum()) for x in last) - 1) < 1e-6


# ---------------------------------------------------------------- classifiers

def _held_out(df, label, threshold, spark):
    from pyspark.sql import functions as F
    labels = read(spark, SF_LABELS, "labels").where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("y"))
    rows = df.where("held_out").join(labels, "doc_id").collect()
    assert all(r["predicted"] == int(r["score"] >= threshold) for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in df.collect())
    return [(r["y"], r["predicted"] == 1) for r in rows]


def test_quality_on_held_out_labels(spark):
    got = factorization.classify(read(spark, SF_LABELS, "documents"), read(spark, SF_LABELS, "labels"))
    found = _held_out(got, "quality", 0.3, spark)
    assert sum(a == b for a, b in found) >= 0.98 * len(found)
    assert got.count() == read(spark, SF_LABELS, "documents").count()


def test_toxicity_on_held_out_labels(spark):
    got = toxicity.classify(read(spark, SF_LABELS, "documents"), read(spark, SF_LABELS, "labels"))
    found = _held_out(got, "toxic", 0.5, spark)
    assert sum(a == b for a, b in found) >= 0.95 * len(found)


def test_pairwise_identity():
    rng = np.random.default_rng(2)
    m = factorization.Model(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    at, x = np.array([3, 7, 20, 41]), rng.normal(size=4).astype(np.float32)
    plain_sum = 0.3 + m.linear[at] @ x + sum(
        m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.score(at, x) - 1 / (1 + math.exp(-plain_sum))) < 1e-6


def test_ftrl_learns_and_stays_sparse():
    texts = [f"{prose(i, 30)} {'nasty' if i % 3 == 0 else 'kind'}" for i in range(300)]
    rows = [(i, np.unique(toxicity.hashed_features(t)).tobytes(), float(i % 3 == 0)) for i, t in enumerate(texts)]
    model = toxicity.fit(rows)
    dense = model.dense()
    assert toxicity.score_text("some nasty words", dense, model.bias) > 0.5 > toxicity.score_text("some kind words", dense, model.bias)
    assert len(model.places) < 300


@pytest.mark.parametrize("module,label", [(factorization, "quality"), (toxicity, "toxic")])
def test_classifiers_on_edge_cases(spark, module, label):
    rows = [(i, 1 if i % 2 else 0) for i in range(1, 18)] + [(3, None), (None, 1), (5, 1), (5, 0)]
    labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
    got = module.classify(edge_docs(spark), labels)
    assert got.count() == len(edge_rows())
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert module.classify(empty_docs(spark), labels).count() == 0
    for some in (labels.limit(0), labels.where(f"{label} = 1")):
        assert module.classify(edge_docs(spark), some).count() == len(edge_rows())


# ------------------------------------------------------------ near duplicates

def _classes(rows, similarity=0.8, weighted=False):
    """Union-find over all pairs; texts without words are alike if equal."""
    sets = []
    for _, t in rows:
        w = plain(t)
        grams = Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([("", t or "")])
        sets.append(grams if weighted else Counter(set(grams)))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((sets[i] & sets[j]).values())
            if shared and shared >= similarity * sum((sets[i] | sets[j]).values()):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def _family(base_seed, n, edits, words=150):
    base = prose(base_seed, words).split()
    out = []
    for k in range(n):
        text = list(base)
        for e in range(edits):
            text[(7 * k + 31 * e) % len(text)] = f"edit{base_seed}x{k}x{e}"
        out.append(" ".join(text))
    return out


def _families():
    texts = _family(11, 12, 1) + _family(12, 12, 3) + _family(13, 10, 5) + [prose(14, 100)] * 20 + ["", "", None, "!!", "!!"]
    return list(enumerate(texts + [prose(s, 120) for s in range(100, 130)]))


def test_near_duplicates_on_families_and_edge_cases(spark):
    for rows in (_families(), edge_rows()):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert by_row(dart_minhash.classes(docs), "doc_id", "class_id") == _classes(rows)
    assert by_row(dart_minhash.classes(edge_docs(spark)), "doc_id", "class_id") == _classes(edge_rows())
    assert dart_minhash.classes(empty_docs(spark)).count() == 0


def test_one_id_on_two_texts_is_two_entries(spark):
    first, second = prose(31, 100), prose(32, 100)
    rows = [(3, first + " more"), (7, first), (7, second), (8, second + " more"), (9, prose(33, 60)), (9, prose(34, 60))]
    rows += [(11, None), (11, ""), (12, prose(35, 60)), (12, prose(35, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_row(dart_minhash.classes(docs), "doc_id", "class_id") == sorted(
        [(3, 3), (7, 3), (7, 7), (8, 7), (9, 9), (9, 9), (11, 11), (11, 11), (12, 12), (12, 12)], key=repr)
    kept = by_row(dart_minhash.one_of_each(docs), "doc_id", "text")
    assert [k for k in kept if k[0] != 11] == sorted([rows[0], rows[2], rows[4], rows[5], rows[8]], key=repr)
    assert sum(k[0] == 11 for k in kept) == 1


def test_sketch_bound_misses_no_more_than_stated():
    p, tail = 0.2 * 15 / 16, lambda m: sum(math.comb(160, i) * p ** i * (1 - p) ** (160 - i) for i in range(m + 1, 161))
    most = dart_minhash._most_differ(160, 0.8)
    assert tail(most) <= dart_minhash.SKETCH_MISS < tail(most - 1)
    assert tail(52) > dart_minhash.SKETCH_MISS  # the bound of 4.5 standard deviations


def test_weighted_near_duplicates(spark):
    line = prose(21, 12)
    rows = [(1, "\n".join([line] * 10 + [prose(22, 40)])), (2, "\n".join([line] * 11 + [prose(22, 40)])),
            (3, "\n".join([line] * 2 + [prose(22, 40)])), (4, prose(23, 50)), (5, prose(23, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(dart_minhash.classes(docs, weight="count"), "doc_id", "class_id") == _classes(rows, weighted=True)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_weighted_similarity(weighted):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    wx = rng.integers(1, 5, 300).astype(float) if weighted else np.ones(300)
    wy = rng.integers(1, 5, 300).astype(float) if weighted else np.ones(300)
    x, y = dict(zip(ids[:300].tolist(), wx, strict=True)), dict(zip(ids[60:360].tolist(), wy, strict=True))
    true = sum(min(x.get(i, 0), y.get(i, 0)) for i in {*x, *y}) / sum(max(x.get(i, 0), y.get(i, 0)) for i in {*x, *y})
    k = 2048
    same = np.mean(dart_minhash.signature(ids[:300], wx, k) == dart_minhash.signature(ids[60:360], wy, k))
    assert abs(same - true) < 4 * (true * (1 - true) / k) ** 0.5


def test_components_of_a_long_chain_and_a_hot_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    got = dict(by_row(dart_minhash.components(spark.createDataFrame(edges, "a long, b long")), "id", "root"))
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = edge_docs(spark)
    kept = dart_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted({d for d, c in _classes(edge_rows()) if d == c and d is not None})
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == want
    assert got.count(None) == 2


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline
    from test_native import _contaminated, _judged
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    before = docs
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        rows[name] = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        if name != "sentencepiece":
            assert after.columns == docs.columns
        before = after
        rows[name + " out"] = sorted(r["doc_id"] for r in after.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "decontamination", "sentencepiece"]
    assert rows["quality_rules out"] == sorted(i for i, t in rows["quality_rules"] if _judged(i, t)[-1])
    assert rows["near_duplicates out"] == sorted(i for i, c in _classes(rows["near_duplicates"]) if i == c)
    items = [tuple(r) for r in read(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert rows["decontamination out"] == sorted(r[0] for r in _contaminated(rows["decontamination"], items) if not r[-1])
    assert rows["sentencepiece out"] == rows["decontamination out"]
    assert before.where("not round_trip").count() == 0
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, sf, "labels").collect()}
    gone = {i for i, _ in rows["toxicity"]} - set(rows["toxicity out"])
    assert sum(labels.get(i) == 0 for i in gone) <= 1


def test_pipeline_on_edge_cases(spark, tmp_path):
    import corpus_pipeline
    sf = str(tmp_path)
    edge_docs(spark).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0), (5, 1), (9, None)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 30)), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.where("not round_trip").count() == 0
    left = [r["doc_id"] for r in got.collect()]
    assert 7 not in left and 1 not in left and 8 not in left and 6 not in left and 9 in left
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
