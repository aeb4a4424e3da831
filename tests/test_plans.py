"""Plan-shape checks: the properties the operators rely on at scale."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from trendloom.functions.text import clean_tokens
from trendloom.operators import graph, pages, prefix, terms, track
from trendloom.operators import status as st
from trendloom.operators.target import target_partition
from trendloom.plans import q_io, q_status
from trendloom.plans.q_io import land_statuses
from trendloom.session import scratch_path
from trendloom.sources import derived
from trendloom.sources.tables import table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_counts_partial_aggregate_below_exchange(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    p = _plan(terms.term_counts(docs))
    ex = p.index("Exchange hashpartitioning(term")
    assert "partial_count" in p[ex:]          # map-side combine under the shuffle
    assert "INSET" in p                         # stop words as a hash-set predicate
    assert "ReadSchema: struct<text:string>" in p   # column pruning at the scan


def test_target_filter_reaches_the_scan(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    p = _plan(target_partition(docs, derived.confidences(spark, SF_SMALL), "purchase", 0.5))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(event_type,purchase\)", p)
    assert "LeftSemi" in p


def test_tracked_terms_meet_tokens_inside_the_scan(spark):
    s = q_status._flat_text(spark, SF_SMALL)
    path = scratch_path(spark, "phrases")
    q_status._phrases(spark).select("phrase").write.text(path)
    p = _plan(track.held_terms(s, track.read_tracking(spark, path)))
    tokens = [line for line in p.splitlines() if "regexp_extract_all" in line]
    assert sum("xxhash64" in line or "explode" in line for line in tokens) >= 1
    assert "Cartesian" not in p and "NestedLoop" not in p
    assert p.count("keys=[_id") == 2            # made distinct below the shuffle, and behind it


def test_a_word_that_all_phrases_share_stays_linear(spark):
    n, word = 400, lambda i: "own" + "".join(chr(97 + i // 26 ** j % 26) for j in range(3))
    statuses = spark.createDataFrame([(i, f"the common words of {word(i % 40)} and the rest") for i in range(n)], "tweet_id long, text string")
    phrases = spark.createDataFrame([(f"the {word(i)}",) for i in range(n)] + [("the common",)], "phrase string")
    held = track.held_terms(statuses, phrases)
    assert held.count() <= 4 * n
    met = track.anchored(held, track.phrase_anchors(phrases))
    assert met.count() == 2 * n                 # one own phrase, and "common"
    assert track.match_phrases(statuses, phrases).count() == 2 * n
    none = spark.createDataFrame([(f"the absent{word(i)}",) for i in range(n)], "phrase string")
    assert track.anchored(track.held_terms(statuses, none), track.phrase_anchors(none)).count() == 0


def test_texts_are_cleaned_once(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    for df in (terms.doc_terms(docs), terms.term_counts(docs), track.held_terms(
            docs, spark.createDataFrame([("a b",)], "phrase string"), "doc_id")):
        p = df._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in p.splitlines() if "regexp_extract_all" in line and "text#" in line]
        assert sum(line.count("https?") for line in scans) == 1, p


def test_photo_limit_ranges_and_writes_keys_only(spark, monkeypatch):
    seen = []
    real = prefix.range_rows

    def spy(df, *args, **kw):
        seen.append(df.columns)
        return real(df, *args, **kw)

    monkeypatch.setattr(prefix, "range_rows", spy)
    s = derived.nested_statuses(spark, SF_SMALL).withColumn("_id", F.col("id_str").cast("long"))
    st.photo_limit(s, 37, ["created_at", "_id"]).count()
    c = table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text")
    pages.zip_lists(c.where("role = 'user'").withColumnRenamed("text", "a"), c.where("role <> 'user'")
                    .withColumnRenamed("text", "b"), ["conv_id"], [F.col("turn")], [F.col("turn")], "a", "b").count()
    assert seen == [["created_at", "_id", "_n", "_all"], ["conv_id", "_side", "_o0", "_h"]]


def test_group_caps_use_partial_window_group_limit(spark):
    s = derived.nested_statuses(spark, SF_SMALL)
    assert "WindowGroupLimit" in _plan(st.distinct_media(s, 3))
    c = table(spark, SF_SMALL, "conversations").select("conv_id", "turn")
    assert "WindowGroupLimit" in _plan(pages.first_n(c, ["conv_id"], [F.col("turn")], 3))


def test_running_sum_has_no_single_partition_exchange_of_rows(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"),
                                  F.lit(1).alias("v"))
    p = _plan(prefix.running_sum(df, F.col("v"), [F.col("k")], ["g"], num_partitions=4))
    assert "SinglePartition" not in p
    p2 = _plan(prefix.running_sum(df, F.col("v"), [F.col("k")], num_partitions=4))
    # only the offsets table (one row per range partition) is gathered, and broadcast
    assert "BroadcastExchange" in p2


def test_tokens_projected_once_for_ngrams(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    p = _plan(terms.document_frequency(docs))
    assert p.count("regexp_extract_all") == 1
    assert "partial_count" in p


def test_phrase_terms_use_same_tokenizer(spark):
    df = spark.createDataFrame([("Fighter-Jet #Storm",)], "phrase string")
    got = df.select(F.array_distinct(clean_tokens("phrase"))).first()[0]
    assert got == ["fighter", "jet", "#storm"]


def test_visited_users_are_never_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = graph.VisitedStore(spark)
    try:
        edges = spark.createDataFrame([(i, (i * 7 + j) % 500, j) for i in range(500) for j in range(3)],
                                      "src long, dst long, nbr_rank long")
        capped, name = graph.bucketed_edges(edges)
        for depth, users in enumerate([[1], [7, 8, 9]]):  # two levels: several files in a bucket
            store.append(spark.createDataFrame([(u, depth, i) for i, u in enumerate(users)],
                                               "user_id long, depth int, visit_order long"))
        found = store.unvisited(graph.candidates(store.level(1), capped))
        p = _plan(found)
        assert "LeftAnti" in p and p.count("Exchange hashpartitioning(dst") == 1 and "Exchange hashpartitioning(user_id" not in p
        scans = [line for line in p.splitlines() if store.name in line and "FileScan" in line]
        assert any("Bucketed: true" in line for line in scans)
        assert any(re.search(r"PartitionFilters: \[[^]]*depth[^]]* = 1", line) for line in scans)
        nxt = {(u * 7 + j) % 500 for u in (7, 8, 9) for j in range(3)}
        assert {r.dst for r in found.collect()} == nxt - {1, 7, 8, 9}
        spark.sql(f"DROP TABLE {name}")
    finally:
        store.drop()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_common_words_of_a_long_list_make_no_rows(spark, monkeypatch):
    """Phrases and statuses meet in the cells of a grid; no pair of them is a row."""
    words = [f"word{chr(97 + i)}" for i in range(12)]
    phrases = [f"{a} {b}" for a in words for b in words] + [" ".join(words[:4]), "absent words", "!!!"]
    said = {i: [w for j, w in enumerate(words) if (i >> j % 5) & 1] for i in range(32)}
    rows = [(i, " ".join(ws)) for i, ws in said.items()] + [(1, " ".join(said[1])), (2, "wordb wordx"), (40, None), (None, "worda")]
    statuses = spark.createDataFrame(rows, "tweet_id long, text string")
    pdf = spark.createDataFrame([(p,) for p in [*phrases, phrases[0]]], "phrase string")
    monkeypatch.setattr(track, "anchored", lambda *a: (_ for _ in ()).throw(AssertionError("pairs as rows")))
    terms_of = [set(p.split()) for p in phrases if p != "!!!"]
    want = sorted((i, t, n) for i, t in rows if i is not None and t is not None
                  and (n := sum(p <= set(t.split()) for p in terms_of)))
    for at_once, short in ((1 << 20, 1 << 14), (20, 0)):  # one cell, and many with all terms sent
        monkeypatch.setattr(track, "PHRASES_AT_ONCE", at_once)
        monkeypatch.setattr(track, "TERMS_AT_ONCE", at_once)
        monkeypatch.setattr(track, "SHORT_LIST", short)
        assert sorted(map(tuple, track.track_filter(statuses, pdf).collect())) == want


def test_statuses_join_their_texts_once(spark):
    p = derived.nested_statuses(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in p            # the media lists come with the events
    texts = [line for line in p.splitlines() if "Join FullOuter" in line]
    assert len(texts) == 3                      # texts and events, events and lists, ids of the lists


def test_few_missing_photos_are_broadcast_from_the_start(spark):
    s = derived.nested_statuses(spark, SF_SMALL)
    p = _plan(st.collect_rows(s, derived.assets(spark, SF_SMALL)))
    assert [line for line in p.splitlines() if "LeftAnti" in line]
    assert all("BroadcastHashJoin" in line for line in p.splitlines() if "LeftAnti" in line)


def test_a_small_landing_is_few_files(spark):
    src = scratch_path(spark, "landing-size")
    land_statuses(spark, derived.nested_statuses(spark, SF_SMALL), src)
    lines = spark.read.text(src).select(F.input_file_name().alias("file"))
    assert lines.distinct().count() < int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lines.count() == derived.nested_statuses(spark, SF_SMALL).count()


def _odd_tables(spark, folder: str) -> str:
    """Documents and events with repeated, one-sided and null ids."""
    docs = [(i, f"text {i}", None if i == 3 else "en", f"src{i % 3}") for i in [*range(1, 14), 4, 5, 5, -7]] + [(None, "no id", "en", "src")]
    events = [(i, 100 + i, None if i == 6 else f"2024-01-01 00:00:{i % 60:02d}", "view", None if i == 9 else '{"k": 1}')
              for i in [*range(4, 20), 5, 8, 8]] + [(None, 1, None, "view", "{}")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    (spark.createDataFrame(events, "event_id long, user_id long, at string, event_type string, props string")
     .withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at").write.parquet(f"{folder}/events.parquet"))
    nations = [(i, f"N{i}") for i in range(-24, 25) if i != 11] + [(2, "N2 again")]
    spark.createDataFrame(nations, "n_nationkey long, n_name string").write.parquet(f"{folder}/nation.parquet")
    return folder


def test_statuses_of_sources_are_the_nested_statuses(spark, tmpdir_path):
    sf = _odd_tables(spark, f"{tmpdir_path}/odd")
    lines = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())
    want, sources = derived.nested_statuses(spark, sf), derived.status_sources(spark, sf)
    got = derived.statuses_of(spark, sf, sources)
    assert got.schema == want.schema and lines(got) == lines(want)
    assert "full_text" not in sources.columns and "_m" not in sources.columns
    p = _plan(got)
    assert p.count("Exchange hashpartitioning") == 2, p  # documents and events, once each
    assert "Exchange hashpartitioning(coalesce" not in p


def test_landings_deal_texts_once_and_compress(spark, tmpdir_path, monkeypatch):
    """What the streams read: narrow rows are dealt by range, lines are compressed, halves are landed together."""
    sf = _odd_tables(spark, f"{tmpdir_path}/odd")
    want = sorted(r[0] for r in derived.nested_statuses(spark, sf).select("id_str").collect())
    dealt = []
    real = q_io.land_statuses
    monkeypatch.setattr(q_io, "land_statuses", lambda s, rows, *a, **k: (dealt.append(rows.columns), real(s, rows, *a, **k)))
    assert q_io.q_stop_at_limit(spark, sf).count() == len([1 for r in derived.nested_statuses(spark, sf).select("text", "id_str").collect()
                                                          if not r.text.startswith("RT")]) - _without_assets(spark, sf)
    assert dealt and "extended_tweet" not in dealt[0] and "body" in dealt[0]
    first, second = q_io._landed_halves(spark, sf)
    ids = [[r.id_str for r in spark.read.json(p).select("id_str").collect()] for p in (first, second)]
    assert sorted(ids[0] + ids[1]) == want and ids[0] and ids[1]
    for path in (first, q_io._drifting(spark, sf)):
        names = {r[0] for r in spark.read.text(path).select(F.input_file_name()).collect()}
        assert names and all(n.endswith(".gz") for n in names)


def _without_assets(spark, sf) -> int:
    s = st.drop_retweets(derived.nested_statuses(spark, sf))
    return s.count() - st.all_media_resolved(s, derived.assets(spark, sf)).count()


def test_texts_of_few_files_are_dealt_to_all_tasks(spark, tmpdir_path):
    rows = spark.createDataFrame([(str(i), f"word{i % 5} and more") for i in range(40)], "id_str string, text string")
    rows.coalesce(1).write.json(f"{tmpdir_path}/one", compression="gzip")
    one = spark.read.schema("id_str string, text string").json(f"{tmpdir_path}/one")
    assert one.rdd.getNumPartitions() == 1
    spread = track._texts_spread(one, "id_str", F.col("text"))
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    phrases = spark.createDataFrame([("word1",), ("word3 more",)], "phrase string")
    got = [sorted(map(tuple, track.track_filter(one, phrases, "id_str", few_files=f).collect())) for f in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 16
