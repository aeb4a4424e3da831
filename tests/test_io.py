"""Sources, sinks and the streaming job on small hand-made files."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from trendloom.operators import detect, track
from trendloom.operators import status as st
from trendloom.operators.target import slot_target_flag
from trendloom.plans.q_io import land_statuses
from trendloom.schemas import COLLECTED_COLUMNS
from trendloom.sources import derived, files, sinks
from trendloom.sources import variants
from trendloom.streaming.first_rows import read_first_rows, run_first_rows
from trendloom.streaming.listing import AssetListing, follow_files
from trendloom.streaming.collect import (Progress, read_collected_sink, read_ledger, read_progress, run_collect_stream)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write(text)


def test_read_tracking(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "tracking.txt")
    _write(p, "fighter jet\n#AvGeek\n\n  @Boeing \nStorm\nstorm\n")
    got = sorted(r.phrase for r in track.read_tracking(spark, p).collect())
    assert got == ["#AvGeek", "@Boeing", "Storm", "fighter jet", "storm"]
    terms = {r.phrase: r.terms for r in track.phrase_table(track.read_tracking(spark, p)).collect()}
    assert sorted(terms["fighter jet"]) == ["fighter", "jet"]
    assert terms["Storm"] == ["storm"]


def test_read_labels(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "names.txt")
    _write(p, "person\nbicycle\naeroplane\n")
    got = [(r.class_id, r.label) for r in detect.read_labels(spark, p).orderBy("class_id").collect()]
    assert got == [(0, "person"), (1, "bicycle"), (2, "aeroplane")]


def test_read_baseline_last_duplicate_wins(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "base.csv")
    _write(p, "term,count,freq\nplane,10,0.001\njet,5,0.0005\nplane,12,0.0012\n")
    got = {r.term: r.freq for r in files.read_baseline(spark, p).collect()}
    assert got == {"plane": 0.0012, "jet": 0.0005}


def test_confidence_docs_and_slot_flag(spark, tmpdir_path):
    base = tmpdir_path
    _write(os.path.join(base, "data/confidences/a.json"), json.dumps({"aeroplane": [0.2, 0.9], "dog": []}))
    _write(os.path.join(base, "data/confidences/b.json"), json.dumps({"dog": [0.9]}))
    _write(os.path.join(base, "data/confidences/c.json"), json.dumps({"aeroplane": []}))
    docs = files.read_confidence_docs(spark, os.path.join(base, "data/confidences/*.json"), base)
    assert sorted(r.path for r in docs.collect()) == [
        "data/confidences/a.json", "data/confidences/b.json", "data/confidences/c.json"]
    rows = spark.createDataFrame([
        ("1", "data/confidences/b.json", "data/confidences/a.json"),   # target in slot 1
        ("2", "data/confidences/b.json", None),                          # no target key
        ("3", "data/confidences/c.json", None),                          # empty list
        ("4", "data/confidences/missing.json", None),                    # missing file
        ("5", None, None)], "tweet_id string, csv_to_json_file_path_0 string, csv_to_json_file_path_1 string")
    for i in (2, 3):
        rows = rows.withColumn(f"csv_to_json_file_path_{i}", F.lit(None).cast("string"))
    got = {r.tweet_id: r.has_target for r in slot_target_flag(rows, docs, "aeroplane", 0.5).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": False, "5": False}


def test_collected_csv_round_trip_with_awkward_text(spark, tmpdir_path):
    vals = {c: None for c in COLLECTED_COLUMNS}
    rows = []
    for i, text in enumerate(['say "hi", then\nleave', "", "plain", " padded "]):
        r = dict(vals, user_id="u", tweet_id=str(i), text=text, truncated=False, quote_count=1)
        rows.append(tuple(r[c] for c in COLLECTED_COLUMNS))
    from trendloom.schemas import COLLECTED
    df = spark.createDataFrame(rows, COLLECTED)
    out = os.path.join(tmpdir_path, "collected")
    sinks.write_collected(df, out)
    back = {r.tweet_id: r.text for r in files.read_collected(spark, out).collect()}
    assert back["0"] == 'say "hi", then\nleave'
    assert back["2"] == "plain" and back["3"] == " padded "
    assert back["1"] in ("", None)
    with open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]) as f:
        assert f.readline().strip() == ",".join(COLLECTED_COLUMNS)


def test_asset_listing_and_rewrite(spark, tmpdir_path):
    base = tmpdir_path
    for name in ("a.jpg", "b.jpg"):
        _write(os.path.join(base, "data/images", name), "x")
    listing = files.list_assets(spark, os.path.join(base, "data/images"), base)
    assert sorted(r.path for r in listing.collect()) == ["data/images/a.jpg", "data/images/b.jpg"]
    t = os.path.join(base, "table")
    spark.createDataFrame([("1", "data/images/a.jpg"), ("2", "data/images/zz.jpg"), ("3", "")],
                          "tweet_id string, image_file_0 string").write.parquet(t)
    sinks.rewrite_table(spark, t, lambda s, p: s.read.parquet(p),
                        lambda d: st.has_asset(d, listing, "image_file_0", "path"),
                        lambda d, p: d.write.parquet(p))
    now = sinks.current_version(spark, t)
    assert [r.tweet_id for r in spark.read.parquet(now).collect()] == ["1"]
    # a write that was not committed leaves the current version as it is
    os.makedirs(os.path.join(t, "version=000002"))
    assert sinks.current_version(spark, t) == now
    for _ in range(2):
        sinks.rewrite_table(spark, t, lambda s, p: s.read.parquet(p), lambda d: d, lambda d, p: d.write.parquet(p))
    assert sinks.current_version(spark, t).endswith("version=000003")
    assert not os.path.exists(os.path.join(t, "version=000001"))
    kept_old = st.has_asset(spark.read.parquet(sinks.current_version(spark, t)).unionByName(
        spark.createDataFrame([("3", "")], "tweet_id string, image_file_0 string")),
        listing, "image_file_0", "path", require_nonempty=False)
    assert sorted(r.tweet_id for r in kept_old.collect()) == ["1", "3"]


def test_user_partitions_skip_existing(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "users")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "user_id long, name string")
    assert sinks.write_user_partitions(spark, a, p) == 2
    b = spark.createDataFrame([(2, "changed"), (3, "z")], "user_id long, name string")
    assert sinks.write_user_partitions(spark, b, p) == 1
    got = sorted((r.user_id, r.name) for r in spark.read.json(p).collect())
    assert got == [(1, "x"), (2, "y"), (3, "z")]


def test_user_partitions_are_known_by_their_folders(spark, tmpdir_path):
    """No file of a stored user is opened: one that cannot be read is a user all the same; a run
    without a new user writes nothing, and names that are escaped in folders are found again."""
    p = os.path.join(tmpdir_path, "users")
    os.makedirs(os.path.join(p, "user_id=7"))
    _write(os.path.join(p, "user_id=7", "part-0.json.gz"), "no gzip")
    a = spark.createDataFrame([(7, "old"), (8, "new")], "user_id long, name string")
    assert sinks.write_user_partitions(spark, a, p) == 1
    stored = spark.read.parquet(written(a, tmpdir_path))
    assert sinks.write_user_partitions(spark, stored, p) == 0
    assert sorted(n for n in os.listdir(p) if n.startswith("user_id=")) == ["user_id=7", "user_id=8"]
    q = os.path.join(tmpdir_path, "names")
    b = spark.createDataFrame([("a/b=c%", 1), ("é", 2)], "user_id string, n long")
    assert [sinks.write_user_partitions(spark, b, q) for _ in range(2)] == [2, 0]
    got = files.read_user_partitions(spark, q, "user_id string, n long")
    assert sorted((r.user_id, r.n) for r in got.collect()) == [("a/b=c%", 1), ("é", 2)]
    none = os.path.join(tmpdir_path, "none")
    assert sinks.write_user_partitions(spark, a.where("user_id < 0"), none) == 0
    assert files.read_user_partitions(spark, none, "user_id long, name string").count() == 0


def written(df, folder):
    path = os.path.join(folder, "written")
    df.write.parquet(path)
    return path


def _statuses_small(spark):
    return derived.nested_statuses(spark, SF_SMALL)


def halves(statuses):
    cut = statuses.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    return statuses.where(F.col("created_at") <= F.lit(cut)), statuses.where(F.col("created_at") > F.lit(cut))


def test_stream_equals_batch_with_bad_records_and_progress(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    s = _statuses_small(spark)
    land_statuses(spark, s, src, 3)
    _write(os.path.join(src, "statuses-99999.json"), '{"id_str": "broken", "text": \n')
    progress = Progress()
    run_collect_stream(spark, src, os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ckpt"),
                       assets=derived.assets(spark, SF_SMALL), rejects=os.path.join(tmpdir_path, "rej"),
                       progress=progress, name="collect_t1")
    got = read_collected_sink(spark, os.path.join(tmpdir_path, "sink"))
    want = st.collect_rows(s, derived.assets(spark, SF_SMALL))
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert spark.read.parquet(os.path.join(tmpdir_path, "rej")).count() >= 1


def test_stream_limit_exact_and_restart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    s = _statuses_small(spark)
    first_half, second_half = halves(s)
    land_statuses(spark, first_half, src, 2)
    sink, ckpt = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ckpt")
    assets = derived.assets(spark, SF_SMALL)
    run_collect_stream(spark, src, sink, ckpt, assets=assets, limit=100, max_files_per_trigger=1)
    first = read_collected_sink(spark, sink).count()
    land_statuses(spark, second_half, src, 2)
    run_collect_stream(spark, src, sink, ckpt, assets=assets, limit=100, max_files_per_trigger=1)
    got = read_collected_sink(spark, sink)
    want = st.collect_rows(s, assets).withColumn("_id", F.col("tweet_id").cast("long"))
    want_ids = [r.tweet_id for r in want.orderBy("created_at", "_id").limit(100).collect()]
    assert got.count() == min(100, want.count())
    assert sorted(r.tweet_id for r in got.collect()) == sorted(want_ids)
    assert got.select("tweet_id").distinct().count() == got.count()
    assert first <= 100


def test_stream_photo_limit_equals_batch_for_any_batches(spark, tmpdir_path):
    s = _statuses_small(spark).limit(400).cache()
    assets = derived.assets(spark, SF_SMALL)
    rows = st.collect_rows(s, assets, photos_col="_photos").withColumn("_id", F.col("tweet_id").cast("long"))
    want = sorted(r.tweet_id for r in st.photo_limit(rows, 50, ["created_at", "_id"], F.col("_photos")).collect())
    for n_files, per_trigger in ((5, 1), (4, 3), (1, 1)):
        base = os.path.join(tmpdir_path, f"{n_files}-{per_trigger}")
        src, sink = os.path.join(base, "src"), os.path.join(base, "sink")
        land_statuses(spark, s, src, n_files)
        run_collect_stream(spark, src, sink, os.path.join(base, "ckpt"), assets=assets, limit=50,
                           photos_as_limit=True, max_files_per_trigger=per_trigger)
        assert sorted(r.tweet_id for r in read_collected_sink(spark, sink).collect()) == want


def test_photo_limit_that_is_never_met_exactly_stops(spark, tmpdir_path):
    """Three statuses of two photos, limit 3: the second is refused, and the
    query stops, with a continuous trigger too."""
    s = _statuses_small(spark)
    two = s.where(F.size(st.photo_urls()) == 2).where(~F.col("text").startswith("RT")).orderBy("created_at").limit(3)
    src, sink = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "sink")
    land_statuses(spark, two, src, 3)
    state = run_collect_stream(spark, src, sink, os.path.join(tmpdir_path, "ckpt"), limit=3, photos_as_limit=True,
                               max_files_per_trigger=1, available_now=False, timeout_s=300)
    assert state["done"] and read_collected_sink(spark, sink).count() == 1


def test_limit_stops_the_default_stream(spark, tmpdir_path):
    src, sink, ckpt = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ckpt"))
    land_statuses(spark, _statuses_small(spark), src, 12)
    state = run_collect_stream(spark, src, sink, ckpt, limit=10, max_files_per_trigger=1)
    assert state["done"] and read_collected_sink(spark, sink).count() == 10
    assert read_ledger(spark, sink).count() < 12
    before = read_ledger(spark, sink).count()
    assert run_collect_stream(spark, src, sink, ckpt, limit=10, max_files_per_trigger=1)["done"]
    assert read_ledger(spark, sink).count() == before


def test_two_runs_append_to_one_sink(spark, tmpdir_path):
    sink = os.path.join(tmpdir_path, "sink")
    first_half, second_half = halves(_statuses_small(spark))
    counts = []
    for i, half in enumerate((first_half, second_half)):
        src = os.path.join(tmpdir_path, f"src{i}")
        land_statuses(spark, half, src, 2)
        run_collect_stream(spark, src, sink, os.path.join(tmpdir_path, f"ckpt{i}"), max_files_per_trigger=1)
        counts.append(read_collected_sink(spark, sink).count())
    assert counts[0] == st.drop_retweets(first_half).count()
    assert counts[1] == counts[0] + st.drop_retweets(second_half).count()


def test_progress_is_kept_whatever_the_session_keeps(spark, tmpdir_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        src, sink = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "sink")
        s = _statuses_small(spark)
        land_statuses(spark, s, src, 6)
        run_collect_stream(spark, src, sink, os.path.join(tmpdir_path, "ckpt"), max_files_per_trigger=1)
        got = read_progress(spark, sink).first()
        assert (got.batches, got.statuses) == (6, s.count())
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_no_machine_local_scratch_on_a_cluster(spark, monkeypatch):
    import pytest
    from trendloom import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_stream_restart_after_failure_has_no_duplicates(spark, tmpdir_path):
    """A batch fails after its rows were written (before the commit); the
    restarted query replays it into the same batch folder, so nothing is
    duplicated or lost."""
    import pytest
    src = os.path.join(tmpdir_path, "src")
    s = _statuses_small(spark)
    land_statuses(spark, s, src, 3)
    sink, ckpt = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ckpt")
    assets = derived.assets(spark, SF_SMALL)

    def crash(batch_id):
        if batch_id == 1:
            raise RuntimeError("executor lost")

    with pytest.raises(Exception):
        run_collect_stream(spark, src, sink, ckpt, assets=assets, max_files_per_trigger=1,
                           after_batch=crash)
    run_collect_stream(spark, src, sink, ckpt, assets=assets, max_files_per_trigger=1)
    got = read_collected_sink(spark, sink)
    want = st.collect_rows(s, assets)
    assert got.count() == want.count()
    assert got.select("tweet_id").distinct().count() == got.count()


def test_stream_processing_time_trigger_stops_at_limit(spark, tmpdir_path):
    """ST7 with a continuous trigger: the driver stops the query between
    batches once the ledger reaches the limit."""
    src = os.path.join(tmpdir_path, "src")
    s = _statuses_small(spark)
    land_statuses(spark, s, src, 3)
    sink = os.path.join(tmpdir_path, "sink")
    state = run_collect_stream(spark, src, sink, os.path.join(tmpdir_path, "ckpt"),
                               assets=derived.assets(spark, SF_SMALL), limit=40,
                               max_files_per_trigger=1, available_now=False, timeout_s=300)
    assert state["done"]
    assert read_collected_sink(spark, sink).count() == 40


def test_loop_track_collect_clean_trend_track(spark, tmpdir_path):
    """track -> collect -> clean -> find terms -> track, through files."""
    from trendloom.operators import terms
    from trendloom.plans.jobs import clean_job, collect_batch_job, trending_files_job
    base = tmpdir_path
    s = _statuses_small(spark)
    src = os.path.join(base, "statuses")
    sinks.write_statuses(s, src)
    _write(os.path.join(src, "zz-bad.json"), "{not json\n")
    tracking = os.path.join(base, "tracking.txt")
    _write(tracking, "#src1\n#src2\n#src3\n#src4\n#src5\n\n")
    collected = os.path.join(base, "data.csv")
    n = collect_batch_job(spark, src, collected, tracking, derived.assets(spark, SF_SMALL),
                          rejects_path=os.path.join(base, "rejects"))
    assert n > 0
    assert spark.read.parquet(os.path.join(base, "rejects")).count() == 1
    rows = files.read_collected(spark, collected).collect()
    assert len(rows) == n
    # land the images of every other row, and a confidence document per landed image
    landed = [r for i, r in enumerate(rows) if r.image_file_0 and i % 2 == 0]
    for i, r in enumerate(landed):
        _write(os.path.join(base, r.image_file_0), "jpg")
        score = 0.9 if i % 3 else 0.1
        _write(os.path.join(base, r.csv_to_json_file_path_0), json.dumps({"aeroplane": [score], "dog": []}))
    clean_job(spark, collected, os.path.join(base, "data/images"), base)
    cleaned = files.read_collected(spark, sinks.current_version(spark, collected))
    assert cleaned.count() == len(landed)
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    baseline = terms.baseline_from_texts(conv, "id")
    out = os.path.join(base, "next_tracking")
    top = trending_files_job(spark, collected, os.path.join(base, "data/confidences/*.json"), base,
                             baseline, out, "aeroplane", 0.5, 50, 1)
    written = [r.value for r in spark.read.text(out).collect()]
    assert written == [r.term for r in top.orderBy("rank").collect()]
    assert 0 < len(written) <= 50
    # the new list is a valid tracking list for the next collection round
    again = collect_batch_job(spark, src, os.path.join(base, "round2.csv"), out,
                              derived.assets(spark, SF_SMALL))
    assert again > 0


def test_listing_follows_files_and_is_not_shuffled(spark, tmpdir_path):
    """New files are appended once, over restarts and repeated batches; a
    micro-batch's URLs are dealt to the listing's buckets."""
    folder, ckpt = os.path.join(tmpdir_path, "images"), os.path.join(tmpdir_path, "ckpt")
    listing = AssetListing(spark, os.path.join(tmpdir_path, "listing"))
    for names in (["a.jpg", "sub/b.jpg", "note.txt"], ["c.jpg"], []):
        for name in names:
            os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
            _write(os.path.join(folder, name), "x" * len(name))
        follow_files(listing, folder, ckpt)
    want = [("a.jpg", 5), ("c.jpg", 5), ("sub/b.jpg", 9)]
    rows = lambda: sorted((r.asset, r.length) for r in listing.table().collect())
    assert rows() == want
    again = spark.createDataFrame([("a.jpg", 7), ("d.jpg", None), ("d.jpg", 3), (None, 1)], "asset string, length long")
    for _ in range(2):  # a batch that is replayed
        listing.add(again)
    assert rows() == [*want[:2], ("d.jpg", 3), want[2]]
    found = AssetListing(spark, os.path.join(tmpdir_path, "listing"))  # by a later run
    assert found.table().count() == 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = st.all_media_resolved(_statuses_small(spark), found.media())
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan[:plan.index(found.name)]
    assert "Exchange hashpartitioning(_url" in plan and plan.count("Exchange hashpartitioning(_url") == 1
    assert "Exchange" not in scan[scan.rindex("Sort ["):]  # from the listing's scan up to the join
    for table in (listing, found):
        table.drop()


def test_stream_sees_assets_that_land_between_its_starts(spark, tmpdir_path):
    src, sink, ckpt = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ckpt"))
    first_half, second_half = halves(_statuses_small(spark))
    landed = derived.assets(spark, SF_SMALL)
    listing = AssetListing(spark)
    land_statuses(spark, first_half, src, 2)
    run_collect_stream(spark, src, sink, ckpt, assets=listing, max_files_per_trigger=1)
    none = read_collected_sink(spark, sink)
    assert none.where(F.col("image_file_0").isNotNull()).count() == 0
    n_before = none.count()
    listing.add(landed, "media_url", F.lit(None))
    land_statuses(spark, second_half, src, 2)
    run_collect_stream(spark, src, sink, ckpt, assets=listing, max_files_per_trigger=1)
    assert read_collected_sink(spark, sink).count() == n_before + st.collect_rows(second_half, landed).count()
    listing.drop()


def test_a_batch_asks_the_listing_without_sorting_it(spark, tmpdir_path):
    listing = AssetListing(spark, os.path.join(tmpdir_path, "listing"), 4)
    landed = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("media_url"))
    listing.add(landed, "media_url", F.lit(None))
    listing.add(landed.union(spark.createDataFrame([("more",)], "media_url string")), "media_url", F.lit(None))
    asked = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("more",), ("none",), (None,)], "media_url string")
    found = listing.media(asked)
    assert sorted(r.media_url for r in found.collect()) == ["more", "u1", "u2"]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan
    listing.drop()


def test_landed_waves_of_a_redelivery(spark):
    """The later wave has the statuses of both halves, each once."""
    from trendloom.plans.q_io import _landed_halves
    ids = lambda path: sorted(r.id_str for r in files.read_statuses(spark, path).collect())
    want = sorted(r.id_str for r in _statuses_small(spark).collect())
    first, again = _landed_halves(spark, SF_SMALL, again=True)
    assert ids(again) == want and 0 < len(ids(first)) < len(want)


def test_redelivered_statuses_are_left_out(spark, tmpdir_path):
    """Within a batch, between batches and after a restart; broken lines are known by
    their text, and records without an id are kept as they are told apart by what they say."""
    src, sink, ckpt, rejects = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ckpt", "rejects"))
    os.makedirs(src)
    line = lambda i, t: '{"id_str": %s, "text": "%s", "created_at": "2024-01-01T00:00:00.000000"}\n' % (i, t)
    _write(os.path.join(src, "a.json"), line('"1"', "one") * 2 + line("null", "no id") + '{"id_str": broken\n')
    run = lambda: run_collect_stream(spark, src, sink, ckpt, rejects=rejects, redelivery="1 day")
    run()
    _write(os.path.join(src, "b.json"), line('"1"', "one again") + line('"2"', "two") + line("null", "no id either")
           + '{"id_str": broken\n' + '{"id_str": other\n')
    run()
    run()  # nothing new
    got = sorted((r.tweet_id or "", r.text) for r in read_collected_sink(spark, sink).collect())
    assert got == [("", "no id"), ("", "no id either"), ("1", "one"), ("2", "two")]
    assert spark.read.parquet(rejects).count() == 2


def test_first_rows_in_event_time(spark, tmpdir_path):
    """Files in falling order of time; a failed batch is replayed; within the delay
    the query stops before it has read everything."""
    import pytest
    s = _statuses_small(spark)
    assets = derived.assets(spark, SF_SMALL)
    rows = st.collect_rows(s, assets).withColumn("_id", F.col("tweet_id").cast("long"))
    want = [r.tweet_id for r in rows.orderBy("created_at", "_id").limit(60).collect()]
    first_half, second_half = halves(s)
    src, sink, ckpt = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ckpt"))
    land_statuses(spark, second_half, src, 2)
    land_statuses(spark, first_half, src, 2)

    def crash(batch_id):
        if batch_id == 1:
            raise RuntimeError("executor lost")

    with pytest.raises(Exception):
        run_first_rows(spark, src, sink, ckpt, 60, assets, after_batch=crash)
    assert not run_first_rows(spark, src, sink, ckpt, 60, assets)
    ids = lambda path: [r.tweet_id for r in read_first_rows(spark, path).withColumn("_id", F.col("tweet_id").cast("long"))
                        .orderBy("created_at", "_id").collect()]
    assert ids(sink) == want
    src2, sink2, ckpt2 = (os.path.join(tmpdir_path, n) for n in ("src2", "sink2", "ckpt2"))
    land_statuses(spark, s, src2, 8)  # in order: final as soon as a later time is read
    assert run_first_rows(spark, src2, sink2, ckpt2, 60, assets, delay="1 second", available_now=False, timeout_s=300)
    assert ids(sink2) == want
    assert len(os.listdir(os.path.join(sink2, "rows"))) < 8
    assert run_first_rows(spark, src2, sink2, ckpt2, 60, assets, delay="1 second")  # stays final
    empty = os.path.join(tmpdir_path, "empty")
    os.makedirs(empty)
    assert not run_first_rows(spark, empty, os.path.join(tmpdir_path, "s3"), os.path.join(tmpdir_path, "c3"), 5)
    assert read_first_rows(spark, os.path.join(tmpdir_path, "s3")).count() == 0


def test_records_of_drifting_shape(spark, tmpdir_path):
    """Every member of a record stands for itself, whatever the others hold."""
    _write(os.path.join(tmpdir_path, "a.json"), "\n".join([
        '{"id_str": 5, "user": {"id_str": "7", "protected": "true", "extra": [1]}, "favorite_count": "12", "new": {"x": 1}}',
        '{"id_str": "6", "user": "nobody", "favorite_count": "many", "created_at": "2024-02-01T10:00:00.000001"}',
        '{"id_str": "8", "user": {"id_str": {"odd": 1}, "screen_name": "ann"}, "entities": {"media": [{"type": "photo"}]}, "new": null}',
        '{"id_str": "9", "entities": {"media": "none"}, "place": null}', "", "{broken", "[1, 2]", '"text"', "{}"]))
    records = variants.read_records(spark, tmpdir_path)
    got = {r.id_str: r for r in variants.typed_statuses(records).drop("record").collect()}
    assert set(got) == {"5", "6", "8", "9", None}
    assert (got["5"].user.id_str, got["5"].user.protected, got["5"].favorite_count) == ("7", True, 12)
    assert got["6"].user is None and got["6"].favorite_count is None and got["6"].created_at.microsecond == 1
    assert got["8"].user.screen_name == "ann" and got["8"].entities.media[0].type == "photo"
    assert got["8"].entities.media[0].media_url is None
    assert got["9"].place is None and got["9"].entities.media is None
    assert {r.field: r.n for r in variants.unknown_fields(records).collect()} == {"new": 2}
    assert [r[0] for r in records.where(F.col(files.CORRUPT).isNotNull()).select(files.CORRUPT).collect()] == ["{broken"]
    whole = variants.typed_statuses(records).where("id_str = '5'").select(F.to_json("record").alias("j")).first().j
    assert '"new":{"x":1}' in whole and '"extra":[1]' in whole
    empty = os.path.join(tmpdir_path, "none")
    os.makedirs(empty)
    assert variants.typed_statuses(variants.read_records(spark, empty)).count() == 0


def test_stream_writes_collected_rows_with_an_entropy_coder(spark, tmpdir_path):
    """Ids and paths are hashes in hex: half of their bytes go with zstd."""
    import glob

    import pyarrow.parquet as pq
    src, sink, ckpt = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ckpt"))
    land_statuses(spark, _statuses_small(spark), src, 2)
    run_collect_stream(spark, src, sink, ckpt, max_files_per_trigger=1)
    files_ = glob.glob(os.path.join(sink, "data", "**", "*.parquet"), recursive=True)
    kinds = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files_ if pq.ParquetFile(f).metadata.num_row_groups}
    assert kinds == {"ZSTD"}
