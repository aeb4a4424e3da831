"""Property and brute-force checks of the operators (small inputs)."""

import collections
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from trendloom.functions.text import clean_text, clean_tokens, ngrams_range
from trendloom.operators import detect, graph, pages, prefix, terms, track
from trendloom.operators import status as st
from trendloom.plans import q_graph
from trendloom.sources import derived
from trendloom.sources.tables import table


def test_clean_text_is_idempotent_on_tokens(spark):
    """Adjacent replacements can leave two spaces, so the string may change
    on a second pass; the token sequence must not."""
    from trendloom.functions.text import tokenize
    texts = ["Hello, World! http://x.y/z rest\nnext line", "#tag @user_name x_y", "",
             "ÉTÉ à l'école — 3.5%", "RT @a: https://t.co/abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(clean_text("t").alias("c"))
    twice = once.select(tokenize(clean_text("c")).alias("k2"), tokenize("c").alias("k1"))
    assert all(r.k1 == r.k2 for r in twice.collect())


def test_tokens_shape(spark):
    """Expected tokens written by hand."""
    cases = [
        ("Fly the A340 #AvGeek @Boeing_Air and #a @ # x",
         ["fly", "the", "a340", "#avgeek", "@boeing", "air", "and", "#", "a", "@", "#", "x"]),
        ("call 555 123 4567 or 1 800 555 1234 now", ["call", "555 123 4567", "or", "1 800 555 1234", "now"]),
        ("id 5551234 and 12345", ["id", "5551234", "and", "12345"]),
        ("boeing737 a380 ab12 f16s", ["boeing", "737", "a380", "ab12", "f16s"]),
        ("8d 8D 8p d8 8day so8", ["8d", "8d", "8p", "d8", "8d", "ay", "so8"]),
        ("##### @@@@@ ###", ["#", "#", "#", "@", "@", "@", "#", "#", "#"]),
        ("I don't think they've left", ["i", "don", "t", "think", "they", "ve", "left"]),
        ("", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", clean_tokens("t").alias("k")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text


def test_contraction_pieces_are_stop_words(spark):
    docs = spark.createDataFrame([(1, "I don't think they've left, isn't it? We'll see")], "doc_id long, text string")
    assert sorted(r.term for r in terms.term_counts(docs).collect()) == ["left", "see", "think"]


def test_ngrams_short_inputs(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), ([],), (["a", "b", "c"],)], "k array<string>")
    got = [r.g for r in df.select(ngrams_range("k", 1, 3).alias("g")).collect()]
    assert got == [["a"], ["a", "b", "a b"], [], ["a", "b", "c", "a b", "b c", "a b c"]]


def test_tf_sums_to_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    s = terms.term_frequency(docs).agg(F.sum("tf")).first()[0]
    assert abs(s - 1.0) < 1e-9


def test_stop_words_as_dataframe_equal_list(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    from trendloom.functions.stopwords import ENGLISH_STOP_WORDS
    sw = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "term string")
    a = sorted(terms.term_counts(docs).collect())
    b = sorted(terms.term_counts(docs, stop_words=sw).collect())
    assert a == b


def _brute_nms(boxes, t):
    def iou(a, b):
        ix = max(0, min(a["x"] + a["bw"], b["x"] + b["bw"]) - max(a["x"], b["x"]))
        iy = max(0, min(a["y"] + a["bh"], b["y"] + b["bh"]) - max(a["y"], b["y"]))
        inter = ix * iy
        union = a["bw"] * a["bh"] + b["bw"] * b["bh"] - inter
        return inter / union if union > 0 else 0.0
    kept = []
    for b in sorted(boxes, key=lambda r: (-r["confidence"], r["pos"])):
        if all(iou(k, b) <= t + 1e-7 for k in kept):
            kept.append(b)
    return [k["pos"] for k in kept]


def test_nms_matches_brute_force(spark):
    raw = derived.detections(spark, SF_MID)
    dec = [r.asDict() for r in detect.decode_detections(raw, 0.3).collect()]
    by_img = collections.defaultdict(list)
    for r in dec:
        by_img[r["image_id"]].append(r)
    kept = collections.defaultdict(list)
    for r in detect.suppress_overlaps(raw, 0.3, 0.3).orderBy("image_id", "keep_rank").collect():
        kept[r.image_id].append(r.pos)
    for img, boxes in by_img.items():
        assert kept[img] == _brute_nms(boxes, 0.3)


def test_confidence_map_has_every_label(spark):
    raw = derived.detections(spark, SF_SMALL)
    m = detect.confidence_map(raw, derived.class_labels(spark), 0.3, 0.3)
    sizes = {r[0] for r in m.select(F.size("detected")).collect()}
    assert sizes == {59}
    assert m.count() == raw.select("image_id").distinct().count()


def test_target_in_map_missing_and_empty(spark):
    df = spark.createDataFrame(
        [({"purchase": [0.2, 0.7]},), ({"purchase": []},), ({"other": [0.9]},), (None,),
         ({"purchase": [0.5]},)], "d map<string,array<double>>")
    got = [r[0] for r in df.select(detect.target_in_map(F.col("d"), "purchase", 0.5)).collect()]
    assert got == [True, False, False, False, False]


def test_track_plans_agree_with_brute_force(spark):
    s = derived.nested_statuses(spark, SF_SMALL).select(
        F.col("id_str").cast("long").alias("tweet_id"), st.full_text().alias("text"))
    phrases = ["#src3", "@Purchase", "thon thth", "Elle de", "lost words", "ble", "#", "!!!"]
    pdf = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    small = sorted(map(tuple, track.match_phrases(s, pdf).collect()))
    toks = {r.tweet_id: set(r.k) for r in s.select("tweet_id", clean_tokens("text").alias("k")).collect()}
    pt = {r.phrase: set(r.terms) for r in track.phrase_table(pdf).collect()}
    assert "!!!" not in pt
    brute = sorted((i, p) for i, tk in toks.items() for p, ts in pt.items() if ts <= tk)
    assert small == brute


def test_track_filter_with_repeated_ids(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha x"), (2, "beta y"), (3, "alpha beta"), (4, None)]
    s = spark.createDataFrame(rows, "tweet_id long, text string")
    pdf = spark.createDataFrame([("alpha beta",), ("beta alpha",), ("x",)], "phrase string")
    got = sorted((r.tweet_id, r.text, r.n_phrases) for r in track.track_filter(s, pdf).collect())
    assert got == [(1, "alpha beta", 2), (1, "alpha beta", 2), (2, "alpha x", 1), (3, "alpha beta", 2)]


def test_track_filter_with_a_long_list(spark):
    phrases = [f"t{i} o{i % 7}" for i in range(3000)]
    s = spark.createDataFrame([(i, f"say t{i} and o{i % 5}") for i in range(0, 3000, 10)], "tweet_id long, text string")
    pdf = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = sorted(r.tweet_id for r in track.track_filter(s, pdf).collect())
    assert got == [i for i in range(0, 3000, 10) if i % 7 == i % 5]


def test_running_sum_with_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, (i * 13) % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): r.running for r in
           prefix.running_sum(df, F.col("v"), [F.col("k")], ["g"], num_partitions=6).collect()}
    acc = collections.Counter()
    for g, k, v in sorted(rows, key=lambda r: (r[0], r[1])):
        acc[g] += v
        assert got[(g, k)] == acc[g]
    glob = {r.k: r.running for r in prefix.running_sum(df, F.col("v"), [F.col("k")], num_partitions=5,
                                                       inclusive=False).collect()}
    total = 0
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        assert glob[k] == total
        total += v


def test_bfs_depth_brute_force(spark):
    e = derived.edges(spark, SF_MID)
    capped = graph.cap_neighbours(e, 2, q_graph.spread_order()).collect()
    adj = collections.defaultdict(list)
    for r in sorted(capped, key=lambda r: (r.src, r.nbr_rank)):
        adj[r.src].append(r.dst)
    seen, order, q = {1: 0}, [1], collections.deque([1])
    while q:
        u = q.popleft()
        for v in adj[u]:
            if v not in seen:
                seen[v] = seen[u] + 1
                order.append(v)
                q.append(v)
    got = graph.snowball(e, 1, 2, q_graph.spread_order()).orderBy("visit_order").collect()
    assert [r.user_id for r in got] == order
    assert {r.user_id: r.depth for r in got} == seen


def test_cap_plans_use_partial_group_limit(spark):
    e = derived.edges(spark, SF_SMALL)
    plan = graph.cap_neighbours(e, 2, q_graph.spread_order())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_user_images_protected_and_existing(spark):
    s = derived.nested_statuses(spark, SF_SMALL)
    base = {r.user_id: r.n_images for r in graph.user_images(s, 3).collect()}
    prot = {int(r.u) for r in s.where(F.col("user.protected")).select(F.col("user.id_str").alias("u")).collect()}
    assert prot and all(base[u] == 0 for u in prot)
    some = [u for u, n in base.items() if n > 0][:2]
    ex = spark.createDataFrame([(u,) for u in some], "user_id long")
    after = {r.user_id: r.n_images for r in graph.user_images(s, 3, ex).collect()}
    assert all(after[u] == 0 for u in some)
    assert all(after[u] == n for u, n in base.items() if u not in some)


def test_photo_limit_is_exact(spark):
    s = derived.nested_statuses(spark, SF_SMALL).withColumn("_id", F.col("id_str").cast("long"))
    got = st.photo_limit(s, 37, ["created_at", "_id"]).collect()
    assert max(r.photos_so_far for r in got) <= 37
    allrows = sorted(((r.created_at, r._id, r.n) for r in s.select(
        "created_at", "_id", F.size(st.photo_urls()).alias("n")).collect()))
    acc, want = 0, []
    for c, i, n in allrows:
        acc += n
        if acc <= 37:
            want.append(i)
    assert sorted(r._id for r in got) == sorted(want)


def test_distinct_media_counts_duplicates_toward_limit(spark):
    media = [Row(type="photo", media_url=u) for u in ["a", "a", "b"]]
    rows = [("2", "u1", media), ("1", "u1", [Row(type="photo", media_url="c")])]
    df = spark.createDataFrame(rows, "id_str string, uid string, m array<struct<type:string,media_url:string>>")
    df = df.select("id_str", F.struct(F.col("uid").alias("id_str")).alias("user"),
                   F.struct(F.col("m").alias("media")).alias("entities"))
    got = sorted(r.media_url for r in st.distinct_media(df, 2).collect())
    assert got == ["a"]
    got3 = sorted(r.media_url for r in st.distinct_media(df, 3).collect())
    assert got3 == ["a", "b"]


def test_custom_tokenizer_hook(spark):
    docs = spark.createDataFrame([(1, "a-b a-b c"), (2, "c")], "doc_id long, text string")
    got = {r.term: r.n for r in terms.term_counts(
        docs, stop_words=None, tokenizer=lambda c: F.split(c, " ")).collect()}
    assert got == {"a-b": 2, "c": 2}
    df = {r.term: r.df for r in terms.document_frequency(
        docs, 2, tokenizer=lambda c: F.split(c, " ")).collect()}
    assert df["a-b a-b"] == 1 and df["c"] == 2


def test_running_max_exclusive_with_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i, (i * 37) % 101) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): r.m for r in prefix.running_agg(
        df, F.col("v"), [F.col("k")], ["g"], out="m", inclusive=False, how="max",
        num_partitions=5).collect()}
    best = {}
    for g, k, v in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[(g, k)] == best.get(g)
        best[g] = max(best.get(g, v), v)


def test_nms_of_one_hot_image(spark):
    """One image that holds every candidate: same answer as the brute force."""
    raw = derived.detections(spark, SF_MID)
    one = raw.withColumn("image_id", F.lit(7).cast("long"))
    dec = [r.asDict() for r in detect.decode_detections(one, 0.3).collect()]
    got = [r.pos for r in detect.suppress_overlaps(one, 0.3, 0.3).orderBy("keep_rank").collect()]
    assert got == _brute_nms(dec, 0.3)


def _raw_boxes(rows):
    """(image_id, pos, cx, cy, bw, bh in pixels, score) as detector output over 4096 pixels."""
    return [(i, p, 4096, 4096, [cx / 4096, cy / 4096, bw / 4096, bh / 4096, 1.0, s]) for i, p, cx, cy, bw, bh, s in rows]


RAW_BOX = "image_id long, pos long, w int, h int, vec array<double>"


def test_crowded_images_in_rounds_equal_the_fold(spark, monkeypatch):
    """Boxes of all sizes, copies, ties, boxes without area and a null image, over thresholds."""
    rnd = random.Random(5)
    rows = []
    for pos in range(240):
        size = rnd.choice([1, 3, 17, 64, 65, 400])
        rows.append((rnd.choice([None, 1, 2]), pos, rnd.randrange(20, 300), rnd.randrange(20, 300),
                     size, rnd.choice([size, size, 2 * size, 0]), rnd.choice([0.5, 0.6, rnd.random()])))
    rows += [(1, 1000 + i, 100, 100, 64, 64, 0.7) for i in range(20)] + [(3, 2000, 9, 9, 4, 4, 0.9)]
    raw = spark.createDataFrame(_raw_boxes(rows), RAW_BOX).checkpoint()
    for t in (0.0, 0.3):
        want = sorted(map(str, detect.suppress_overlaps(raw, 0.3, t).collect()))
        with monkeypatch.context() as m:
            m.setattr(detect, "FOLD_BOXES", 40)
            assert sorted(map(str, detect.suppress_overlaps(raw, 0.3, t).collect())) == want, t


def test_a_hundred_thousand_chained_boxes(spark):
    """One image of boxes that chain over both axes: kept boxes do not overlap, every
    other overlaps a better kept one, and no list of pairs is made."""
    n, step = 100_000, 9
    raw = (spark.range(n).select(
        F.lit(1).cast("long").alias("image_id"), F.col("id").alias("pos"), F.lit(4096).alias("w"), F.lit(4096).alias("h"),
        F.array(F.expr(f"(20 + id % 400 * {step}) / 4096D"), F.expr(f"(20 + id div 400 * {step}) / 4096D"),
                F.lit(16 / 4096), F.lit(16 / 4096), F.lit(1.0), F.expr("0.4D + pmod(xxhash64(id), 1000000) / 2000000D")).alias("vec")))
    place = {(r.x, r.y): (-r.confidence, r.pos, r) for r in detect.decode_boxes(raw).collect()}
    kept = {r.pos for r in detect.suppress_overlaps(raw, 0.3, 0.1).collect()}
    near = [(dx, dy) for dx in (-step, 0, step) for dy in (-step, 0, step) if (dx, dy) != (0, 0)]
    for (x, y), (k, pos, _) in place.items():
        better = [place[x + dx, y + dy] for dx, dy in near if (x + dx, y + dy) in place
                  and (16 - abs(dx)) * (16 - abs(dy)) / (512 - (16 - abs(dx)) * (16 - abs(dy))) > 0.1]
        assert (pos in kept) == (not any(b[:2] < (k, pos) and b[1] in kept for b in better))


def test_class_list_of_any_length(spark):
    labels = spark.range(150_000).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("c"), "id").alias("label"))
    raw = spark.createDataFrame([(1, 0, 10, 10, [0.5, 0.5, 0.2, 0.2, 1.0, 0.1, 0.9])],
                                "image_id long, pos long, w int, h int, vec array<double>")
    doc = detect.confidence_map(raw, labels).select(F.size("detected"), "detected.c1", "detected.c149999").first()
    assert tuple(doc) == (150_000, [0.9], [])


def test_model_is_loaded_once_per_worker(spark, tmpdir_path):
    marks = tmpdir_path

    def load():
        import os
        import uuid
        open(os.path.join(marks, uuid.uuid4().hex), "w").close()

        def model(pdf):
            pdf = pdf[["id"]].copy()
            pdf["pid"] = os.getpid()
            return pdf
        return model

    df = spark.range(1600).repartition(16)
    scored = detect.score_images(df.withColumn("x", F.lit(0)), load, "x", ["id"], "id long, pid long")
    workers = {r.pid for r in scored.collect()}
    import os
    assert len(os.listdir(marks)) == len(workers) < 16


def test_photo_limit_counts_each_delivery(spark):
    media = [Row(type="photo", media_url="a"), Row(type="photo", media_url="b")]
    rows = [("1", 1, media), ("2", 2, media), ("2", 2, media), ("3", 3, []), ("4", 4, media)]
    df = spark.createDataFrame(rows, "id_str string, created_at int, m array<struct<type:string,media_url:string>>")
    df = df.select("id_str", "created_at", F.struct(F.col("m").alias("media")).alias("extended_entities"))
    got = sorted((r.id_str, r.photos_so_far) for r in st.photo_limit(df, 4).collect())
    assert got == [("1", 2), ("2", 4)]
    got = sorted((r.id_str, r.photos_so_far) for r in st.photo_limit(df, 7).collect())
    assert got == [("1", 2), ("2", 4), ("2", 6), ("3", 6)]


def test_top_n_without_a_limit_ranks_from_one(spark):
    df = spark.range(1000).select(F.col("id").alias("n")).repartition(8)
    got = terms.top_n(df, [F.col("n").desc()], None).collect()
    assert sorted((r["rank"], r.n) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_page_patterns_by_hand(spark):
    from trendloom.operators import pages
    html = {
        "content first": ('<meta content="u&amp;v" property="og:image">', "u&v"),
        "single quotes": ("<meta property='og:image' content='a\"b'>", 'a"b'),
        "spaces and case": ('<META  Property = "og:image"\n Content = "x" />', "x"),
        "other property first": ('<meta property="og:title" content="t"><meta property="og:image" content="y">', "y"),
        "value in another value": ('<meta name="property=og:image" content="no">', None),
        "absent": ("<p>none</p>", None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in html.items()], "k string, html string")
    got = {r.k: r.m for r in df.select("k", pages.page_meta("html", "og:image").alias("m")).collect()}
    assert got == {k: v[1] for k, v in html.items()}
    links = spark.createDataFrame([("""<img data-src="lazy.jpg" src="real.jpg"><img SRC='b.jpg'>""",)], "html string")
    assert links.select(pages.page_links("html", "src").alias("l")).first().l == ["real.jpg", "b.jpg"]
    caption = spark.createDataFrame([("<li><div><span>A &lt;b&gt; <i>c</i></span></div></li><time>",), ("<li><span>x</span>",)],
                                    "html string")
    assert [r.c for r in caption.select(pages.page_caption("html").alias("c")).collect()] == ["A <b> c", ""]


def test_bfs_with_one_hot_source_and_no_cap(spark):
    """One source holds a third of the edges; no neighbour is cut."""
    import random
    rng = random.Random(5)
    pairs = {(7, d) for d in range(100, 400)} | {(1, 7), (1, 8)}
    while len(pairs) < 900:
        pairs.add((rng.randrange(1, 300), rng.randrange(1, 300)))
    pairs = {(a, b) for a, b in pairs if a != b}
    adj = collections.defaultdict(list)
    for a, b in sorted(pairs):
        adj[a].append(b)
    seen, order, q = {1: 0}, [1], collections.deque([1])
    while q:
        u = q.popleft()
        for v in adj[u]:
            if v not in seen:
                seen[v] = seen[u] + 1
                order.append(v)
                q.append(v)
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = graph.snowball(e, 1).orderBy("visit_order").collect()
    assert [r.user_id for r in got] == order and {r.user_id: r.depth for r in got} == seen


def test_page_tokens_comments_scripts_entities(spark):
    cases = [
        ('<!-- <meta property="og:image" content="old.jpg"> --><meta property="og:image" content="a.jpg">', "a.jpg", []),
        ('<script><meta property="og:image" content="s.jpg"></script><img src=plain.jpg>', None, ["plain.jpg"]),
        ('<META Property=og:image Content=b.jpg?x=1&amp;y=2><a href="x>y" src=\'q "r"\'>', "b.jpg?x=1&y=2", ['q "r"']),
        ("<meta property='og:image' content='caf&eacute;&#233;&#xe9;&#150;&lt;&NotEqualTilde;&#0;&nosuch;&copy&copy=1'>",
         "cafééé–<≂̸�&nosuch;©&copy=1", []),
        ('<!-->x<img src="1.jpg"><!-- open <img src="2.jpg">', None, ["1.jpg"]),
        ('<!DOCTYPE html><textarea><img src="no.jpg"></TEXTAREA ><img/src="3.jpg"/><img src="4.jpg', None, ["3.jpg"]),
        ('<script src="js.js">if (a < b) "<img src=no>"</script><img data-src="no" src>', None, ["js.js"]),
        ('<title>a <img src="no.jpg"> </title><p title="a > b" src=" s ">', None, [" s "]),
        (None, None, None), ("", None, []),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(cases)], "page_id long, html string").select(
        "page_id", pages.page_meta("html", "og:image").alias("m"), pages.page_links("html", "src").alias("l"))
    got = {r["page_id"]: (r["m"], r["l"]) for r in rows.collect()}
    for i, (_, meta, links) in enumerate(cases):
        assert got[i] == (meta, links), i


def test_entities_equal_the_standard_library(spark):
    import html
    from html.entities import html5
    from trendloom.functions.html import unescape
    texts = [f"x &{k} y" for k in html5 if k.endswith(";")] + [f"&#{n}; &#x{n:x};" for n in (9, 65, 126, 128, 0x92, 233, 8364, 0xD800, 0x1F600, 0x10FFFD)]
    texts += ["a & b && &; &# &#x &#; no", "&amp;lt;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(4)
    for r in rows.select("t", unescape(rows["t"]).alias("u")).collect():
        assert r["u"] == html.unescape(r["t"]), r["t"]


def test_rarest_grams_are_exact_for_any_sample(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    want = [(r.term, r.df) for r in terms.document_frequency(docs).orderBy("df", "term").limit(60).collect()]
    for share in (0.02, 0.3, 1.0):  # small samples have fewer grams than asked for, whole ones give close bounds
        got = terms.rarest_grams(docs, 60, share=share).orderBy("df", "term").collect()
        assert [(r.term, r.df) for r in got] == want
    # every gram twice: the bound moves out until it is gone
    twice = docs.where("doc_id < 40").union(docs.where("doc_id < 40"))
    want = [(r.term, r.df) for r in terms.document_frequency(twice).orderBy("df", "term").limit(5).collect()]
    assert [(r.term, r.df) for r in terms.rarest_grams(twice, 5, share=1.0).orderBy("df", "term").collect()] == want
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert terms.rarest_grams(none, 5).count() == 0
