"""Landed-page and post-crawl operators (P10-P15, T5, F11, G3 list cut).

Pages are rows (page_id, url, html); extraction is Column expressions over the
page's tokens (``functions/html.py``), one pass per page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.html import attribute, attributes, is_element, tags, unescape
from trendloom.operators.prefix import ordinal

DEFAULT_HOST = "https://photos.example/"
TAG_PATH = "explore/tags/"
# fixed values: the embedded JSON keys that hold a page's post count
COUNT_KEYS = ("edge_hashtag_to_media", "edge_owner_to_timeline_media")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _metas(html) -> Column:
    """The meta tags of a page, each as its array of attributes."""
    found = F.filter(tags(_c(html)), lambda t: is_element(t, "meta"))
    return F.transform(found, attributes)


def page_meta(html, prop: str, attr: str = "property") -> Column:
    """P10: ``content`` of the first meta tag whose ``attr`` is ``prop``, with
    its attributes in any order and either quote, decoded; null when absent."""
    values = F.transform(F.filter(_metas(html), lambda a: attribute(a, attr) == prop), lambda a: attribute(a, "content"))
    return F.nullif(F.get(values, F.lit(0)), F.lit(""))


def meta_attr(html, attr: str) -> Column:
    """Value of ``attr`` on the first meta element carrying it (e.g. charset)."""
    values = F.filter(F.transform(_metas(html), lambda a: attribute(a, attr)), lambda v: v.isNotNull())
    return F.nullif(F.get(values, F.lit(0)), F.lit(""))


def page_links(html, attr: str = "src", pattern: str | None = None, n: int | None = None) -> Column:
    """Values of the attribute ``attr`` (quoted or not, decoded) of the
    page's tags in order, optionally only those matching ``pattern``, first ``n``
    (None = all).  Comments, scripts and other raw text hold no tags; a longer
    name that ends in ``attr`` (data-src) is another attribute."""
    named = F.filter(tags(_c(html)), lambda t: t.rlike(r"(?i)[\s/]" + re.escape(attr) + r"\s*="))
    links = F.transform(named, lambda t: attribute(attributes(t), attr))
    links = F.filter(links, lambda u: u.isNotNull())
    if pattern is not None:
        links = F.filter(links, lambda u: u.rlike(pattern))
    if n is not None:
        links = F.slice(links, 1, n)
    return links


def page_caption(html) -> Column:
    """The caption of a post page: the text of the first span of a list item
    before the page's time element, tags dropped and decoded; '' when the
    page has no time element or no such span."""
    before = F.regexp_extract(_c(html), r"(?is)^(.*?)<time[\s>]", 1)
    span = F.regexp_extract(before, r"(?is)<li[^>]*>\s*(?:<div[^>]*>\s*)*<span[^>]*>(.*?)</span>", 1)
    return unescape(F.regexp_replace(span, r"<[^>]*>", ""))


def page_post_count(html) -> Column:
    """The post count embedded in the page JSON (first of the known
    keys), null when absent."""
    keys = "|".join(COUNT_KEYS)
    pat = '(?:' + keys + ')":[{]"count":([0-9]+)'
    return F.regexp_extract(_c(html), pat, 1).try_cast("long")


def posts_to_fetch(html, number: int) -> Column:
    """min(number, post count); the number itself when no count."""
    return F.least(F.lit(number).cast("long"), page_post_count(html))


def target_plan(queries: DataFrame, host: str = DEFAULT_HOST, query_col: str = "query") -> DataFrame:
    """Query -> kind (hashtag / user), page URL and directory name.
    Hashtags: URL uses the query with '#' stripped at both ends, the
    directory strips leading '#' and adds '.hashtag'."""
    q = F.col(query_col)
    tag = q.startswith("#")
    both = F.regexp_replace(q, r"^#+|#+$", "")
    lead = F.regexp_replace(q, r"^#+", "")
    return queries.select(
        "*",
        F.when(tag, F.lit("hashtag")).otherwise(F.lit("user")).alias("kind"),
        F.concat(F.lit(host), F.when(tag, F.concat(F.lit(TAG_PATH), both)).otherwise(q)).alias("url"),
        F.when(tag, F.concat(lead, F.lit(".hashtag"))).otherwise(q).alias("dir_name"),
    )


def route_by_kind(plan: DataFrame, type_col: str = "crawl_type") -> DataFrame:
    """which job serves each request: photos -> posts, followers /
    following -> follow (a hashtag has none: invalid), else unknown."""
    t = F.col(type_col)
    return plan.withColumn(
        "route",
        F.when(t == "photos", F.lit("posts"))
         .when(t.isin("followers", "following") & (F.col("kind") == "hashtag"), F.lit("invalid"))
         .when(t.isin("followers", "following"), F.lit("follow"))
         .otherwise(F.lit("unknown")))


def first_line(col) -> Column:
    """Text before the first newline."""
    return F.substring_index(_c(col), "\n", 1)


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int,
            rank_col: str = "rank") -> DataFrame:
    """T5: the first ``n`` rows per group (0 = all) with their rank.  With
    n > 0 a partial WindowGroupLimit cuts each group before the shuffle;
    n = 0 ranks everything with the skew-safe segmented count."""
    if n == 0:
        return ordinal(df, order, group, out=rank_col)
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("long"))
              .where(F.col(rank_col) <= n))


def zip_lists(left: DataFrame, right: DataFrame, key: list[str], order_left: list[Column],
              order_right: list[Column], value_left: str, value_right: str) -> DataFrame:
    """Pair the i-th item of the left list with the i-th of the right
    list per key, stopping at the shorter list.

    Items are numbered once, as (key, side, order, hash of the value) rows by
    the segmented running count (no per-key single-task window, and no value
    in it); the numbered rows of both sides are paired by an equi-join on
    (key, ordinal), and then the values are joined back."""
    def items(df: DataFrame, order: list[Column], value: str, side: str) -> DataFrame:
        return df.select(*key, F.lit(side).alias("_side"), *[c.alias(f"_o{i}") for i, c in enumerate(order)],
                         F.xxhash64(F.col(value)).alias("_h"), F.col(value).alias("_value"))

    a, b = items(left, order_left, value_left, "a"), items(right, order_right, value_right, "b")
    keys = [c for c in a.columns if c.startswith("_o")] + ["_h"]
    narrow = a.drop("_value").unionByName(b.drop("_value"))
    numbered = ordinal(narrow, [F.col(c) for c in keys], [*key, "_side"], out="_i")

    def side(name: str) -> DataFrame:
        return numbered.where(F.col("_side") == name).select(*key, "_i", *[F.col(c).alias(f"{c}_{name}") for c in keys])

    def valued(pairs: DataFrame, rows: DataFrame, name: str, value: str) -> DataFrame:
        # equal items are one value
        values = rows.groupBy(*key, *keys).agg(F.first("_value").alias(value))
        values = values.select(*key, *[F.col(c).alias(f"{c}_{name}") for c in keys], value)
        return pairs.join(values, [*key, *[f"{c}_{name}" for c in keys]])

    pairs = side("a").join(side("b"), [*key, "_i"])
    pairs = valued(valued(pairs, a, "a", value_left), b, "b", value_right)
    return pairs.select(*key, F.col("_i").alias("pos"), value_left, value_right)
