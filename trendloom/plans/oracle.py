"""DuckDB SQL for each registered query (the independent oracle).

Derived views are inlined as CTEs built from the stock tables, with the
exact SQL of FIXTURES.md.  Text patterns are the same fixed values as in
``trendloom.functions.text``; DuckDB needs the 'g' flag to replace all.
"""

from __future__ import annotations

from trendloom.functions.stopwords import sql_list
from trendloom.functions.text import CLEAN_PATTERN, HANG_PATTERN, TOKEN_PATTERN

VIEWS = {
    "statuses": """
SELECT x.tweet_id AS tweet_id, x.user_id AS user_id, x.created_at AS created_at, x.source AS source, x.lang AS lang,
       CASE WHEN x.tweet_id % 10 = 3 THEN concat('RT ', x.body)
            WHEN x.tweet_id % 10 = 4 THEN concat('RTX ', x.body)
            ELSE x.body END AS text,
       CASE WHEN x.tweet_id % 4 = 0 THEN NULL
            ELSE concat(x.body, ' #', x.source, ' @', x.event_type,
                        CASE WHEN x.tweet_id % 5 = 0 THEN concat(' https://t.example/', CAST(x.tweet_id AS VARCHAR(20)), ' lost words')
                             ELSE '' END) END AS full_text,
       CASE WHEN x.tweet_id % 7 = 0 THEN CAST(x.tweet_id % 360 - 180 AS DOUBLE) END AS longitude,
       CASE WHEN x.tweet_id % 7 = 0 THEN CAST(x.tweet_id % 180 - 90 AS DOUBLE) END AS latitude,
       CASE WHEN x.tweet_id % 3 = 0 THEN n.n_name END AS place_full_name,
       CASE WHEN x.tweet_id % 3 = 0 THEN 'country' END AS place_type,
       CASE WHEN x.tweet_id % 8 = 0 THEN x.tweet_id - 1 END AS in_reply_to_status_id,
       x.user_id % 13 = 0 AS protected
FROM (SELECT coalesce(d.doc_id, e.event_id) AS tweet_id,
             coalesce(e.user_id, coalesce(d.doc_id, e.event_id) % 997) AS user_id,
             coalesce(e.ts, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * d.doc_id) AS created_at,
             coalesce(d.source, 'events') AS source, coalesce(d.lang, 'und') AS lang,
             coalesce(e.event_type, 'none') AS event_type,
             coalesce(d.text, concat_ws(' ', e.event_type, e.props)) AS body
      FROM documents d FULL JOIN events e ON e.event_id = d.doc_id) x
JOIN nation n ON n.n_nationkey = x.tweet_id % 25""",
    "media": """
SELECT tweet_id, pos, CASE WHEN (tweet_id + pos) % 3 = 0 THEN 'video' ELSE 'photo' END AS type,
       concat('http://img.example/', CAST(img AS VARCHAR(20)), '.jpg') AS media_url, img
FROM (SELECT x.tweet_id, p.pos, CAST(floor((x.tweet_id * 7 + p.pos * 3) / 5) AS BIGINT) AS img
      FROM (SELECT coalesce(d.doc_id, e.event_id) AS tweet_id FROM documents d FULL JOIN events e ON e.event_id = d.doc_id) x
      CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p
      WHERE p.pos < x.tweet_id % 6) m""",
    "assets": "SELECT DISTINCT media_url FROM media WHERE img % 11 <> 0",
    "confidences": """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS image_id, event_type AS label,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 100.0E0 AS confidence, event_id AS pos
FROM events""",
    "edges": """
SELECT DISTINCT src, dst FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events) t
WHERE dst IS NOT NULL AND src <> dst""",
    "queries": """
SELECT doc_id AS query_id,
       CASE WHEN doc_id % 3 = 0 THEN concat('#', source) WHEN doc_id % 3 = 1 THEN concat('##', source) ELSE concat(lang, '_', source) END AS query,
       CASE WHEN doc_id % 5 = 0 THEN 'followers' WHEN doc_id % 5 = 1 THEN 'following' WHEN doc_id % 5 = 2 THEN 'other' ELSE 'photos' END AS crawl_type
FROM documents""",
    "post_pages": """
SELECT page_id, url, concat(html,
  '<!-- <meta property="og:image" content="old.jpg"><img src="old.png"> --><script>var m = ''<meta property="og:image" content="script.jpg"><img src="script.png">'';</script><b title=''<meta property="og:image" content="title.jpg">''></b>',
  CASE WHEN page_id % 4 = 0 THEN ''
       WHEN page_id % 5 = 0 THEN concat('<meta property="og:image" content="http://img.example/', CAST(page_id AS VARCHAR(20)), '.jpg">')
       WHEN page_id % 5 = 1 THEN concat('<meta content="http://img.example/', CAST(page_id AS VARCHAR(20)), '.jpg" property="og:image"/>')
       WHEN page_id % 5 = 2 THEN concat('<meta property=''og:image'' content=''http://img.example/', CAST(page_id AS VARCHAR(20)), '.jpg''>')
       WHEN page_id % 5 = 3 THEN concat('<META name="a > b" property="og:image" content="http://img.example/', CAST(page_id AS VARCHAR(20)), '.jpg?a=1&amp;b=2" />')
       ELSE concat('<meta property="og:title" content="x"><meta  property = "og:image"  content = "http://img.example/', CAST(page_id AS VARCHAR(20)), '.jpg">') END,
  '<img data-src="lazy.jpg" src="real-', CAST(page_id AS VARCHAR(20)), '.jpg"><img src=plain-', CAST(page_id AS VARCHAR(20)), '.jpg>',
  CASE WHEN page_id % 3 = 0 THEN concat('{"edge_hashtag_to_media":{"count":', CAST(page_id * 5 AS VARCHAR(20)), '}}')
       WHEN page_id % 3 = 1 THEN concat('{"edge_owner_to_timeline_media":{"count":', CAST(page_id + 2 AS VARCHAR(20)), '}}') ELSE '' END,
  CASE WHEN page_id % 7 = 0 THEN ''
       WHEN page_id % 7 = 1 THEN '<article><ul><li><span>no time</span></li></ul></article>'
       ELSE concat('<article><ul><li class="c"><div><span>Post ', CAST(page_id AS VARCHAR(20)),
                   ' <b>by</b> A &amp; B, caf&eacute;&#233;&#xE9; &copy;&#150;&nosuch;</span></div></li><li><span>reply</span></li></ul><time datetime="2024-01-01"></time></article>') END) AS html
FROM pages""",
}

# views that other views need first
_DEPS = {"assets": ["media"]}


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {ctes}\n{body}"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = sql_list()


def tokens_expr(text: str) -> str:
    """DuckDB twin of ``clean_tokens``."""
    low = f"lower(regexp_replace({text}, {sq(CLEAN_PATTERN)}, ' ', 'g'))"
    low = f"regexp_replace({low}, {sq(HANG_PATTERN)}, '\\1\\2', 'g')"
    return f"regexp_extract_all({low}, {sq(TOKEN_PATTERN)})"


def clean_expr(text: str) -> str:
    return f"regexp_replace({text}, {sq(CLEAN_PATTERN)}, ' ', 'g')"


def ngram_expr(tok: str, n: int) -> str:
    if n == 1:
        return f"coalesce({tok}, [])"
    return (f"CASE WHEN len({tok}) >= {n} THEN list_transform(range(0, len({tok}) - {n} + 1), "
            f"lambda i: array_to_string({tok}[i + 1:i + {n}], ' ')) ELSE [] END")


def ngrams3_expr(tok: str) -> str:
    return f"list_concat({ngram_expr(tok, 1)}, {ngram_expr(tok, 2)}, {ngram_expr(tok, 3)})"


ORACLE: dict[str, str] = {}


def oracle(name: str, views: list[str], body: str) -> None:
    ORACLE[name] = with_views(views, body)


# ---------------------------------------------------------------- terms ---
TARGET_DOCS = ("SELECT doc_id, text FROM documents WHERE doc_id IN "
               "(SELECT image_id FROM confidences WHERE label = 'purchase' AND confidence > 0.5)")


def _counts_sql(src: str, stop: bool = True) -> str:
    where = f"WHERE term NOT IN ({STOP})" if stop else ""
    return (f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens_expr('text')}) AS term FROM ({src}) s) t "
            f"{where} GROUP BY term")


BASELINE_SQL = (f"SELECT b.term, CAST(b.n AS DOUBLE) / CAST(t.total AS DOUBLE) AS freq FROM "
                f"({_counts_sql('SELECT text FROM conversations')}) b, "
                f"(SELECT sum(n) AS total FROM ({_counts_sql('SELECT text FROM conversations')}) x) t")

oracle("clean_text", [], f"SELECT doc_id, {clean_expr('text')} AS clean FROM documents")
oracle("tokens", [], f"""SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, array_to_string(tok, ' ') AS tokens
FROM (SELECT doc_id, {tokens_expr('text')} AS tok FROM documents) s""")
oracle("vocabulary", [], f"SELECT DISTINCT term FROM ({_counts_sql('SELECT text FROM documents')}) c")
oracle("term_document_counts", [], f"""SELECT doc_id, term, count(*) AS n FROM
(SELECT doc_id, unnest({tokens_expr('text')}) AS term FROM documents) t
WHERE term NOT IN ({STOP}) GROUP BY doc_id, term""")
oracle("term_counts", [], _counts_sql("SELECT text FROM documents"))
oracle("total_words", [], f"SELECT CAST(sum(n) AS BIGINT) AS total FROM ({_counts_sql('SELECT text FROM documents')}) c")
oracle("term_frequency", [], f"""SELECT c.term, c.n, CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE) AS tf
FROM ({_counts_sql('SELECT text FROM documents')}) c,
     (SELECT sum(n) AS total FROM ({_counts_sql('SELECT text FROM documents')}) x) t""")
oracle("frequent_terms", ["confidences"], f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, term) AS BIGINT) AS rank, term, n, tf FROM (
SELECT c.term, c.n, CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE) AS tf
FROM ({_counts_sql(TARGET_DOCS)}) c, (SELECT sum(n) AS total FROM ({_counts_sql(TARGET_DOCS)}) x) t) r
ORDER BY rank LIMIT 40""")
oracle("target_partition", ["confidences"], f"SELECT doc_id FROM ({TARGET_DOCS}) t")
oracle("partition_report", ["confidences"], f"""SELECT count(*) AS n_rows,
count(*) FILTER (WHERE doc_id IN (SELECT image_id FROM confidences WHERE label = 'purchase' AND confidence > 0.5)) AS n_target
FROM documents""")
oracle("baseline_terms", [], BASELINE_SQL)
oracle("relative_terms", [], f"""SELECT c.term, c.n, (CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE)) / b.freq AS rel
FROM ({_counts_sql('SELECT text FROM documents')}) c,
     (SELECT sum(n) AS total FROM ({_counts_sql('SELECT text FROM documents')}) x) t,
     ({BASELINE_SQL}) b
WHERE c.term = b.term""")
oracle("trending_terms", ["confidences"], f"""SELECT CAST(row_number() OVER (ORDER BY rel DESC, term) AS BIGINT) AS rank, term, n, rel FROM (
SELECT c.term, c.n, (CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE)) / b.freq AS rel
FROM ({_counts_sql(TARGET_DOCS)}) c,
     (SELECT sum(n) AS total FROM ({_counts_sql(TARGET_DOCS)}) x) t,
     ({BASELINE_SQL}) b
WHERE c.term = b.term AND c.n > 10) r
ORDER BY rank LIMIT 400""")
oracle("ngrams", [], f"""SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(g, '|') AS grams FROM
(SELECT doc_id, {ngrams3_expr('tok')} AS g FROM (SELECT doc_id, {tokens_expr('text')} AS tok FROM documents) s) q""")
_DF_SQL = (f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({ngrams3_expr('tok')})) AS term "
           f"FROM (SELECT {tokens_expr('text')} AS tok FROM ({{src}}) s0) s) t GROUP BY term")
oracle("idf_grams", [], f"""SELECT term, df, round(ln((1.0 + N) / (1.0 + df)) + 1.0, 6) AS idf
FROM ({_DF_SQL.replace('{src}', 'SELECT text FROM documents')}) d, (SELECT CAST(count(*) AS DOUBLE) AS N FROM documents) c""")
oracle("tfidf_terms", ["confidences"], f"""SELECT CAST(row_number() OVER (ORDER BY df, term) AS BIGINT) AS rank, term, df,
round(ln((1.0 + N) / (1.0 + df)) + 1.0, 6) AS idf
FROM ({_DF_SQL.replace('{src}', TARGET_DOCS)}) d, (SELECT CAST(count(*) AS DOUBLE) AS N FROM ({TARGET_DOCS}) x) c
ORDER BY rank LIMIT 400""")

# --------------------------------------------------------------- status ---
PHOTOS = ("SELECT tweet_id, list(media_url ORDER BY pos) AS urls FROM media "
          "WHERE type = 'photo' GROUP BY tweet_id")
PHOTO_SLOTS = ("SELECT tweet_id, media_url, pos, "
               "row_number() OVER (PARTITION BY tweet_id ORDER BY pos) - 1 AS slot "
               "FROM media WHERE type = 'photo'")
NOT_RT = "NOT coalesce(starts_with(s.text, 'RT'), false)"
RESOLVED = ("NOT EXISTS (SELECT 1 FROM media m WHERE m.tweet_id = s.tweet_id AND m.type = 'photo' "
            "AND m.media_url NOT IN (SELECT media_url FROM assets))")
_SV = ["statuses", "media", "assets"]
REPLY_COLS = """CAST(s.in_reply_to_status_id AS VARCHAR) AS in_reply_to_status_id,
CASE WHEN s.in_reply_to_status_id IS NOT NULL THEN CAST(s.user_id AS VARCHAR) END AS in_reply_to_user_id,
CASE WHEN s.in_reply_to_status_id IS NOT NULL THEN 'user' || CAST(s.user_id AS VARCHAR) END AS in_reply_to_screen_name"""
PLACE_COLS = """s.longitude, s.latitude, s.place_full_name, s.place_type, lower(s.place_full_name) AS place_id,
'https://places.example/' || lower(s.place_full_name) AS place_url"""

oracle("full_text_flatten", ["statuses"], f"""SELECT CAST(s.user_id AS VARCHAR) AS user_id, CAST(s.tweet_id AS VARCHAR) AS tweet_id,
coalesce(s.full_text, s.text) AS text, s.created_at, s.source, s.full_text IS NOT NULL AS truncated,
{REPLY_COLS}, {PLACE_COLS}, s.lang, s.protected FROM statuses s""")
oracle("drop_retweets", ["statuses"], f"SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id, s.text FROM statuses s WHERE {NOT_RT}")
oracle("photo_urls", ["statuses", "media"], f"""SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id,
CAST(coalesce(len(p.urls), 0) AS BIGINT) AS n_photos, p.urls[1] AS photo_0, p.urls[2] AS photo_1,
p.urls[3] AS photo_2, p.urls[4] AS photo_3, coalesce(array_to_string(p.urls, ' '), '') AS all_photos
FROM statuses s LEFT JOIN ({PHOTOS}) p ON p.tweet_id = s.tweet_id""")
_HASHED = (f"SELECT q.tweet_id, q.slot, q.media_url, sha256(concat_ws('/', CAST(q.tweet_id AS VARCHAR), "
           f"CAST(q.slot AS VARCHAR), q.media_url)) AS h FROM ({PHOTO_SLOTS}) q "
           f"WHERE q.slot < 4 AND q.tweet_id IN (SELECT tweet_id FROM statuses)")
oracle("asset_paths", ["statuses", "media"], f"""SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, CAST(slot AS INTEGER) AS slot, media_url,
'data/images/' || h || '.jpg' AS image_file, 'data/images/' || h || '_marked.jpg' AS marked_up_image_file,
'data/confidences/' || h || '.json' AS csv_to_json_file_path FROM ({_HASHED}) a""")
oracle("all_media_resolved", _SV, f"SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id FROM statuses s WHERE {RESOLVED}")
oracle("has_asset", _SV, f"""SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id FROM statuses s JOIN ({PHOTOS}) p ON p.tweet_id = s.tweet_id
WHERE p.urls[1] IN (SELECT media_url FROM assets)""")
oracle("has_asset_by_column", _SV, f"""SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id FROM statuses s LEFT JOIN ({PHOTOS}) p ON p.tweet_id = s.tweet_id
WHERE p.urls[2] IS NULL OR p.urls[2] IN (SELECT media_url FROM assets)""")
oracle("distinct_media", ["statuses", "media"], """SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, media_url FROM (
SELECT s.user_id, m.media_url, row_number() OVER (PARTITION BY s.user_id ORDER BY s.tweet_id DESC, m.pos) AS rn
FROM statuses s JOIN media m ON m.tweet_id = s.tweet_id WHERE m.type = 'photo') t WHERE rn <= 3""")
oracle("row_limit", ["statuses"], f"""SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id, s.created_at FROM statuses s WHERE {NOT_RT}
ORDER BY s.created_at, s.tweet_id LIMIT 250""")
oracle("photo_limit", ["statuses", "media"], f"""SELECT tweet_id, photos_so_far FROM (
SELECT CAST(s.tweet_id AS VARCHAR) AS tweet_id,
CAST(sum(coalesce(len(p.urls), 0)) OVER (ORDER BY s.created_at, s.tweet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS photos_so_far
FROM statuses s LEFT JOIN ({PHOTOS}) p ON p.tweet_id = s.tweet_id WHERE {NOT_RT}) t WHERE photos_so_far <= 500""")

_SLOT_COLS = ",\n".join(
    [f"'data/images/' || a.h[{i + 1}] || '.jpg' AS image_file_{i}" for i in range(4)]
    + [f"'data/images/' || a.h[{i + 1}] || '_marked.jpg' AS marked_up_image_file_{i}" for i in range(4)]
    + [f"'data/confidences/' || a.h[{i + 1}] || '.json' AS csv_to_json_file_path_{i}" for i in range(4)])
COLLECTED_SQL = f"""SELECT CAST(s.user_id AS VARCHAR) AS user_id, CAST(s.tweet_id AS VARCHAR) AS tweet_id,
coalesce(s.full_text, s.text) AS text,
{_SLOT_COLS},
s.created_at, s.source, s.full_text IS NOT NULL AS truncated, {REPLY_COLS}, {PLACE_COLS},
CAST(0 AS BIGINT) AS quote_count, CAST(0 AS BIGINT) AS reply_count, CAST(0 AS BIGINT) AS retweet_count,
CAST(0 AS BIGINT) AS favorite_count, s.lang
FROM statuses s LEFT JOIN (SELECT tweet_id, list(h ORDER BY slot) AS h FROM ({_HASHED}) x GROUP BY tweet_id) a
  ON a.tweet_id = s.tweet_id
WHERE {NOT_RT} AND {RESOLVED}"""
oracle("collected", _SV, COLLECTED_SQL)
oracle("union_runs", _SV, f"SELECT tweet_id, user_id, created_at, image_file_0 FROM ({COLLECTED_SQL}) c")

TRACKING = ["#src3", "@Purchase", "thon thth", "Elle de", "lost words", "  ",
            "@view #src7", "ble", "@mail5", "#"]
_PHRASES = ("SELECT trim(phrase) AS phrase, list_distinct(" + tokens_expr("trim(phrase)") + ") AS terms FROM (VALUES "
            + ", ".join(f"({sq(p)})" for p in TRACKING) + ") v(phrase) WHERE trim(phrase) <> ''")
TRACK_PAIRS = f"""SELECT t.tweet_id, p.phrase FROM
(SELECT s.tweet_id, {tokens_expr('coalesce(s.full_text, s.text)')} AS tok FROM statuses s) t, ({_PHRASES}) p
WHERE len(p.terms) > 0 AND list_has_all(t.tok, p.terms)"""
oracle("track_filter_small", ["statuses"], TRACK_PAIRS)
oracle("track_filter_indexed", ["statuses"], TRACK_PAIRS)
_TRACKED = f"SELECT tweet_id, count(*) AS n_phrases FROM ({TRACK_PAIRS}) x GROUP BY tweet_id"
oracle("track_filter", ["statuses"], _TRACKED)
oracle("track_filter_duplicates", ["statuses"], f"SELECT * FROM ({_TRACKED}) a UNION ALL SELECT * FROM ({_TRACKED}) b")
LONG_PHRASES = f"""SELECT phrase, list_distinct({tokens_expr('phrase')}) AS terms FROM (
SELECT DISTINCT concat_ws(' ', tok[i], tok[i + 1]) AS phrase FROM
(SELECT {tokens_expr('text')} AS tok FROM documents) d, (VALUES (2), (4)) v(i)) p WHERE phrase <> ''"""
# phrases by their last term, so that DuckDB can use an equi-join
LONG_MATCHES = f"""SELECT t.tweet_id, p.phrase FROM
(SELECT tweet_id, tok, unnest(list_distinct(tok)) AS term FROM
  (SELECT s.tweet_id, {tokens_expr('coalesce(s.full_text, s.text)')} AS tok FROM statuses s) q) t
JOIN ({LONG_PHRASES}) p ON t.term = p.terms[-1] WHERE list_has_all(t.tok, p.terms)"""
oracle("track_filter_long_list", ["statuses"], f"SELECT tweet_id, count(*) AS n_phrases FROM ({LONG_MATCHES}) x GROUP BY tweet_id")
oracle("input_totals", [], """SELECT d.n + e.n AS statuses, d.chars + e.chars AS chars, d.n AS documents FROM
(SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents) d,
(SELECT count(*) AS n, CAST(coalesce(sum(length(concat_ws(' ', event_type, props))), 0) AS BIGINT) AS chars FROM events
 WHERE event_id NOT IN (SELECT doc_id FROM documents)) e""")

# ------------------------------------------------------------ detection ---
DET = """SELECT CAST(floor(vec_id / 10) AS BIGINT) AS image_id, vec_id AS pos, 640 AS w, 480 AS h,
0.5 + CAST(embedding[1] AS DOUBLE) AS cx, 0.5 + CAST(embedding[2] AS DOUBLE) AS cy,
0.2 + abs(CAST(embedding[3] AS DOUBLE)) AS bw, 0.2 + abs(CAST(embedding[4] AS DOUBLE)) AS bh,
list_transform(embedding[6:64], lambda v: abs(CAST(v AS DOUBLE))) AS scores FROM embeddings"""
DEC = f"""SELECT image_id, pos, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS class_id,
list_max(scores) AS confidence, CAST(trunc(cxi - bwi / 2.0) AS INTEGER) AS x, CAST(trunc(cyi - bhi / 2.0) AS INTEGER) AS y,
bwi AS bw, bhi AS bh FROM (SELECT *, CAST(trunc(cx * w) AS INTEGER) AS cxi, CAST(trunc(cy * h) AS INTEGER) AS cyi,
CAST(trunc(bw * w) AS INTEGER) AS bwi, CAST(trunc(bh * h) AS INTEGER) AS bhi FROM ({DET}) d0) d1"""


def _iou(a: str, b: str) -> str:
    inter = (f"(CAST(greatest(0, least({a}.x + {a}.bw, {b}.x + {b}.bw) - greatest({a}.x, {b}.x)) AS DOUBLE) * "
             f"CAST(greatest(0, least({a}.y + {a}.bh, {b}.y + {b}.bh) - greatest({a}.y, {b}.y)) AS DOUBLE))")
    union = f"(CAST({a}.bw AS DOUBLE) * {a}.bh + CAST({b}.bw AS DOUBLE) * {b}.bh - {inter})"
    return f"CAST(1.0 - (1.0 - CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END) AS REAL)"


KEPT = f"""SELECT image_id, CASE WHEN cand IS NULL THEN [] ELSE list_reduce(cand,
  lambda acc, c: CASE WHEN list_bool_or(list_transform(acc, lambda k: {_iou('k', 'c')} > CAST(0.3 AS REAL))) THEN acc
                      ELSE list_append(acc, c) END, cand[1:0]) END AS kept FROM (
SELECT image_id, list(struct_pack(pos := pos, class_id := class_id, confidence := confidence, x := x, y := y, bw := bw, bh := bh)
  ORDER BY confidence DESC, pos) FILTER (WHERE confidence > 0.3) AS cand
FROM ({DEC}) d GROUP BY image_id) g"""
KEPT_ROWS = f"""SELECT image_id, CAST(keep_rank AS INTEGER) AS keep_rank, b.pos AS pos, b.class_id AS class_id,
b.confidence AS confidence, b.x AS x, b.y AS y, b.bw AS bw, b.bh AS bh FROM (
SELECT image_id, unnest(kept) AS b, generate_subscripts(kept, 1) - 1 AS keep_rank FROM ({KEPT}) k WHERE len(kept) > 0) u"""

oracle("best_class", [], f"SELECT pos, class_id, confidence FROM ({DEC}) d")
oracle("decode_detections", [], f"SELECT * FROM ({DEC}) d WHERE confidence > 0.3")
oracle("suppress_overlaps", [], KEPT_ROWS)
oracle("confidence_map", [], f"""SELECT i.image_id, l.label, coalesce(string_agg(printf('%.6f', r.confidence), ',' ORDER BY r.keep_rank), '') AS confidences
FROM (SELECT DISTINCT image_id FROM ({DET}) d) i
CROSS JOIN (SELECT CAST(range AS INTEGER) AS class_id, printf('c%02d', range) AS label FROM range(59)) l
LEFT JOIN ({KEPT_ROWS}) r ON r.image_id = i.image_id AND r.class_id = l.class_id
GROUP BY i.image_id, l.label""")
oracle("caption_label", [], f"""SELECT image_id, pos, printf('%s: %.4f', printf('c%02d', class_id), confidence) AS caption
FROM ({KEPT_ROWS}) r""")
_W = [((i * 7) % 13 - 6) / 10.0 for i in range(64)]
oracle("score_images", [], "SELECT vec_id, label, round(" + " + ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) * {w!r}" for i, w in enumerate(_W)) + ", 6) AS score FROM embeddings")

# ---------------------------------------------------------------- graph ---
CAPPED = ("SELECT src, dst, nbr_rank FROM (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src "
          "ORDER BY (dst * 31 + src * 17) % 151, dst) AS BIGINT) AS nbr_rank FROM edges) e WHERE nbr_rank <= 2")
USER_IMAGES = """SELECT u.user_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_images
FROM (SELECT user_id, bool_or(protected) AS protected FROM statuses GROUP BY user_id) u
LEFT JOIN (SELECT user_id, count(DISTINCT media_url) AS n FROM (
  SELECT s.user_id, m.media_url, row_number() OVER (PARTITION BY s.user_id ORDER BY s.tweet_id DESC, m.pos) AS rn
  FROM statuses s JOIN media m ON m.tweet_id = s.tweet_id WHERE m.type = 'photo' AND NOT s.protected) t
  WHERE rn <= 3 GROUP BY user_id) c ON c.user_id = u.user_id"""
oracle("cap_neighbours", ["edges"], CAPPED)
oracle("user_images", ["statuses", "media"], USER_IMAGES)
oracle("follow_list", ["edges"], """SELECT user_id, kind, other, rank FROM (
SELECT src AS user_id, 'followers' AS kind, dst AS other,
  CAST(row_number() OVER (PARTITION BY src ORDER BY (dst * 31 + src * 17) % 151, dst) AS BIGINT) AS rank FROM edges
UNION ALL
SELECT dst AS user_id, 'following' AS kind, src AS other,
  CAST(row_number() OVER (PARTITION BY dst ORDER BY (dst * 31 + src * 17) % 151, src) AS BIGINT) AS rank FROM edges) f
WHERE rank <= 3""")
oracle("snowball_depths", ["edges"], f"""SELECT * FROM (WITH RECURSIVE capped AS ({CAPPED}),
bfs(user_id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION
  SELECT c.dst, b.depth + 1 FROM bfs b JOIN capped c ON c.src = b.user_id
  WHERE b.depth < (SELECT count(DISTINCT src) + 1 FROM edges))
SELECT user_id, CAST(min(depth) AS INTEGER) AS depth FROM bfs GROUP BY user_id) q""")


def _levels_sql(levels: int = 30) -> str:
    """Breadth-first levels unrolled: level d from level d-1 and everything
    visited before; order inside a level by (parent order, neighbour rank)."""
    parts = ["L0 AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS user_id, 0 AS depth, CAST(0 AS BIGINT) AS vo)",
             "V0 AS MATERIALIZED (SELECT * FROM L0)"]
    for d in range(1, levels + 1):
        parts.append(
            f"L{d} AS MATERIALIZED (SELECT dst AS user_id, {d} AS depth, "
            f"CAST((SELECT count(*) FROM V{d - 1}) + row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS vo FROM "
            f"(SELECT c.dst, min(p.vo * 1000 + c.nbr_rank) AS k FROM L{d - 1} p JOIN capped c ON c.src = p.user_id "
            f"WHERE c.dst NOT IN (SELECT user_id FROM V{d - 1}) GROUP BY c.dst) x)")
        parts.append(f"V{d} AS MATERIALIZED (SELECT * FROM V{d - 1} UNION ALL SELECT * FROM L{d})")
    return ",\n".join(parts) + f"\nSELECT * FROM V{levels}"


ORACLE["snowball_sample"] = with_views(["statuses", "media", "edges"], f"""SELECT user_id, depth, visit_order, n_images, images_before FROM (
SELECT v.user_id, CAST(v.depth AS INTEGER) AS depth, v.vo AS visit_order, CAST(coalesce(i.n_images, 0) AS BIGINT) AS n_images,
  CAST(coalesce(sum(coalesce(i.n_images, 0)) OVER (ORDER BY v.vo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS images_before
FROM (WITH capped AS ({CAPPED}), {_levels_sql()}) v LEFT JOIN ({USER_IMAGES}) i ON i.user_id = v.user_id) s
WHERE images_before < 40""")

# ---------------------------------------------------------------- pages ---
# the values are stated by the shape of each page, not by the engine's patterns
OG_IMAGE = """CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('http://img.example/', CAST(page_id AS VARCHAR(20)), '.jpg',
CASE WHEN page_id % 5 = 3 THEN '?a=1&b=2' ELSE '' END) END"""
CAPTION = """CASE WHEN page_id % 7 < 2 THEN '' ELSE concat('Post ', CAST(page_id AS VARCHAR(20)), ' by A & B, cafééé ©–&nosuch;') END"""
oracle("page_meta", [], f"""SELECT page_id, {OG_IMAGE} AS og_image,
nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset FROM pages""")
oracle("page_caption", [], f"SELECT page_id, {CAPTION} AS caption FROM pages")
oracle("page_images", [], """SELECT page_id, CAST(0 AS INTEGER) AS pos, concat('real-', CAST(page_id AS VARCHAR(20)), '.jpg') AS link FROM pages
UNION ALL SELECT page_id, CAST(1 AS INTEGER) AS pos, concat('plain-', CAST(page_id AS VARCHAR(20)), '.jpg') AS link FROM pages""")
oracle("page_links", [], """SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM (
SELECT page_id, unnest(l[1:10]) AS link, generate_subscripts(l[1:10], 1) - 1 AS pos FROM (
SELECT page_id, regexp_extract_all(replace(html, '&amp;', '&'), '[^-]href="([^"]*)"', 1) AS l FROM pages) a) b""")
oracle("page_jpg_links", [], f"""SELECT page_id, CAST(0 AS INTEGER) AS pos, {OG_IMAGE} AS link FROM pages
WHERE page_id % 4 <> 0 AND page_id % 5 <> 3""")
oracle("page_post_count", ["post_pages"], """SELECT page_id, c AS post_count, least(CAST(100 AS BIGINT), c) AS n_to_fetch FROM (
SELECT page_id, TRY_CAST(nullif(regexp_extract(html, '(?:edge_hashtag_to_media|edge_owner_to_timeline_media)":[{]"count":([0-9]+)', 1), '') AS BIGINT) AS c
FROM post_pages) p""")
TARGET_PLAN = """SELECT query_id, query, crawl_type,
CASE WHEN starts_with(query, '#') THEN 'hashtag' ELSE 'user' END AS kind,
'https://photos.example/' || CASE WHEN starts_with(query, '#') THEN 'explore/tags/' || regexp_replace(query, '^#+|#+$', '', 'g') ELSE query END AS url,
CASE WHEN starts_with(query, '#') THEN regexp_replace(query, '^#+', '') || '.hashtag' ELSE query END AS dir_name
FROM queries"""
oracle("target_plan", ["queries"], TARGET_PLAN)
oracle("route_by_kind", ["queries"], f"""SELECT query_id, CASE WHEN crawl_type = 'photos' THEN 'posts'
WHEN crawl_type IN ('followers', 'following') AND kind = 'hashtag' THEN 'invalid'
WHEN crawl_type IN ('followers', 'following') THEN 'follow' ELSE 'unknown' END AS route FROM ({TARGET_PLAN}) t""")
oracle("first_line", [], "SELECT conv_id, turn, split_part(text, chr(10), 1) AS first_line FROM conversations")
oracle("first_n_posts", [], """SELECT conv_id, turn, role, rank FROM (SELECT conv_id, turn, role,
CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS rank FROM conversations) c WHERE rank <= 3""")
oracle("zip_posts", [], """SELECT u.conv_id, u.i AS pos, u.text AS prompt, a.text AS reply FROM
(SELECT conv_id, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS i FROM conversations WHERE role = 'user') u
JOIN (SELECT conv_id, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS i FROM conversations WHERE role = 'assistant') a
ON a.conv_id = u.conv_id AND a.i = u.i""")

# ----------------------------------------------------- sinks and streams ---
oracle("csv_round_trip", _SV, COLLECTED_SQL)
ORACLE["write_tracking"] = f"SELECT term FROM ({ORACLE['trending_terms']}) t"
oracle("rewrite_table", _SV, f"SELECT tweet_id, image_file_0 FROM ({COLLECTED_SQL}) c WHERE image_file_0 IS NOT NULL")
oracle("user_partitions", ["statuses", "media"], f"""SELECT DISTINCT s.user_id, 'user' || CAST(s.user_id AS VARCHAR) AS screen_name,
s.protected, i.n_images FROM statuses s JOIN ({USER_IMAGES}) i ON i.user_id = s.user_id""")
oracle("posts_sink", [], f"""SELECT regexp_extract(url, '//([^/:]+)', 1) AS query_dir,
'./data/' || regexp_extract(url, '//([^/:]+)', 1) || '/images/' || sha256(link) || '.jpg' AS imagefile, caption
FROM (SELECT url, {OG_IMAGE} AS link, {CAPTION} AS caption FROM pages) p WHERE link IS NOT NULL""")
oracle("confidence_json", [], f"""SELECT i.image_id, coalesce(bool_or(r.class_id = 7 AND r.confidence > 0.3), false) AS has_target,
CAST(59 AS BIGINT) AS n_labels FROM (SELECT DISTINCT image_id FROM ({DET}) d) i LEFT JOIN ({KEPT_ROWS}) r ON r.image_id = i.image_id
GROUP BY i.image_id""")
_FULL = [*_SV]
oracle("collect_stream", _FULL, f"""SELECT c.* FROM ({COLLECTED_SQL}) c
WHERE CAST(c.tweet_id AS BIGINT) IN (SELECT tweet_id FROM ({TRACK_PAIRS}) m)""")
oracle("collect_stream_all", _FULL, COLLECTED_SQL)
oracle("collect_stream_long_list", _FULL, f"""SELECT c.tweet_id, c.created_at FROM ({COLLECTED_SQL}) c
WHERE CAST(c.tweet_id AS BIGINT) IN (SELECT tweet_id FROM ({LONG_MATCHES}) m)""")
oracle("stop_at_limit", _SV, f"SELECT tweet_id, created_at FROM ({COLLECTED_SQL}) c ORDER BY created_at, CAST(tweet_id AS BIGINT) LIMIT 300")
oracle("first_rows_any_order", _SV, f"SELECT tweet_id, created_at FROM ({COLLECTED_SQL}) c ORDER BY created_at, CAST(tweet_id AS BIGINT) LIMIT 300")
_PHOTO_PREFIX = f"""SELECT tweet_id, created_at FROM (SELECT c.tweet_id, c.created_at,
sum(coalesce(len(p.urls), 0)) OVER (ORDER BY c.created_at, CAST(c.tweet_id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS so_far
FROM ({COLLECTED_SQL}) c LEFT JOIN ({PHOTOS}) p ON p.tweet_id = CAST(c.tweet_id AS BIGINT)) t WHERE so_far <= 400"""
oracle("photo_limit_stream", _SV, _PHOTO_PREFIX)
oracle("resume", _SV, f"SELECT tweet_id, user_id, image_file_0 FROM ({COLLECTED_SQL}) c")
oracle("redelivery", _SV, f"SELECT tweet_id, user_id, image_file_0 FROM ({COLLECTED_SQL}) c")
oracle("two_runs_one_sink", _SV, f"SELECT tweet_id, user_id FROM ({COLLECTED_SQL}) c")
oracle("baseline_file", [], BASELINE_SQL)
oracle("stream_progress", ["statuses", "media"], f"""SELECT CAST(count(*) AS BIGINT) AS statuses,
CAST(sum(coalesce(len(p.urls), 0)) AS BIGINT) AS photos FROM statuses s LEFT JOIN ({PHOTOS}) p ON p.tweet_id = s.tweet_id""")
oracle("ingest_rate", ["statuses"], "SELECT CAST(4 AS BIGINT) AS batches, count(*) AS statuses FROM statuses")
oracle("bad_records", ["statuses"], f"""SELECT 'rejected' AS kind, concat('{{"id_str": "', CAST(tweet_id AS VARCHAR), '", "text": ') AS value
FROM statuses WHERE tweet_id % 50 = 7
UNION ALL SELECT 'collected', CAST(s.tweet_id AS VARCHAR) FROM statuses s WHERE s.tweet_id % 50 <> 7 AND {NOT_RT}""")
oracle("read_labels", [], """SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS class_id, event_type AS label
FROM (SELECT DISTINCT event_type FROM events) e""")
oracle("drifting_records", _SV, COLLECTED_SQL)
oracle("unknown_fields", ["statuses"], """SELECT 'edit_history' AS field, count(*) AS n FROM statuses WHERE tweet_id % 4 = 1
UNION ALL SELECT 'note', count(*) FROM statuses WHERE tweet_id % 5 = 2
UNION ALL SELECT '(broken)', count(*) FROM statuses WHERE tweet_id % 50 = 7""")
LANDED_FILES = """SELECT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') || '/shelf=' || CAST(doc_id % 64 AS VARCHAR) AS folder,
CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS length FROM documents GROUP BY ALL"""
oracle("list_assets", [], LANDED_FILES)
oracle("listing_stream", [], LANDED_FILES)
oracle("read_pages", ["post_pages"], f"""SELECT page_id, url, {OG_IMAGE} AS og_image, CAST(length(html) AS BIGINT) AS n_chars FROM post_pages""")

# ------------------------------------------------------------------ jobs ---
oracle("collect_job", _SV, f"""SELECT tweet_id, created_at, text FROM ({COLLECTED_SQL}) c
WHERE CAST(c.tweet_id AS BIGINT) IN (SELECT tweet_id FROM ({TRACK_PAIRS}) m)
ORDER BY created_at, CAST(tweet_id AS BIGINT) LIMIT 300""")
oracle("collect_job_photos", _SV, _PHOTO_PREFIX)
oracle("posts_job", [], f"""SELECT query_dir, './data/' || query_dir || '/images/' || sha256(link) || '.jpg' AS imagefile, caption FROM (
SELECT page_id, regexp_extract(url, '//([^/:]+)', 1) AS query_dir, {OG_IMAGE} AS link, {CAPTION} AS caption,
row_number() OVER (PARTITION BY regexp_extract(url, '//([^/:]+)', 1) ORDER BY page_id) AS i
FROM pages WHERE page_id % 4 <> 0) p WHERE i <= 2""")
_PAIRED = KEPT_ROWS.replace("floor(vec_id / 10)", "floor(vec_id / 2)")
_TARGET_TEXTS = f"""SELECT c.text FROM ({COLLECTED_SQL}) c WHERE c.image_file_0 IS NOT NULL AND CAST(c.tweet_id AS BIGINT) IN
(SELECT image_id FROM ({_PAIRED}) k WHERE class_id = 12 AND confidence > 0.3)"""
oracle("detect_to_target", _SV, f"""SELECT CAST(row_number() OVER (ORDER BY rel DESC, term) AS BIGINT) AS rank, term, n, rel FROM (
SELECT c.term, c.n, (CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE)) / b.freq AS rel
FROM ({_counts_sql(_TARGET_TEXTS)}) c,
     (SELECT sum(n) AS total FROM ({_counts_sql(_TARGET_TEXTS)}) x) t,
     ({BASELINE_SQL}) b
WHERE c.term = b.term AND c.n > 1) r
ORDER BY rank LIMIT 400""")
