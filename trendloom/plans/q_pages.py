"""Registered page / post-crawl queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import pages
from trendloom.plans.catalog import register
from trendloom.sources import derived
from trendloom.sources.tables import table

# fixed parameters of the registered queries
LINKS_PER_PAGE = 10
POSTS_WANTED = 100
TURNS_PER_CONV = 3


@register("page_meta")
def q_page_meta(spark, sf):
    p = derived.post_pages(spark, sf)
    return p.select("page_id", pages.page_meta("html", "og:image").alias("og_image"),
                    pages.meta_attr("html", "charset").alias("charset"))


@register("page_links")
def q_page_links(spark, sf):
    p = derived.post_pages(spark, sf)
    return p.select("page_id", F.posexplode(pages.page_links("html", "href", None, LINKS_PER_PAGE))
                    .alias("pos", "link"))


@register("page_jpg_links")
def q_page_jpg_links(spark, sf):
    p = derived.post_pages(spark, sf)
    return p.select("page_id", F.posexplode(pages.page_links("html", "content", r"\.jpg$", LINKS_PER_PAGE))
                    .alias("pos", "link"))


@register("page_images")
def q_page_images(spark, sf):
    """``src`` of the page's images; ``data-src`` is another attribute."""
    p = derived.post_pages(spark, sf)
    return p.select("page_id", F.posexplode(pages.page_links("html", "src", None, LINKS_PER_PAGE))
                    .alias("pos", "link"))


@register("page_caption")
def q_page_caption(spark, sf):
    return derived.post_pages(spark, sf).select("page_id", pages.page_caption("html").alias("caption"))


@register("page_post_count")
def q_page_post_count(spark, sf):
    p = derived.post_pages(spark, sf)
    return p.select("page_id", pages.page_post_count("html").alias("post_count"),
                    pages.posts_to_fetch("html", POSTS_WANTED).alias("n_to_fetch"))


@register("target_plan")
def q_target_plan(spark, sf):
    return pages.target_plan(derived.crawl_queries(spark, sf))


@register("route_by_kind")
def q_route_by_kind(spark, sf):
    return pages.route_by_kind(pages.target_plan(derived.crawl_queries(spark, sf))).select(
        "query_id", "route")


@register("first_line")
def q_first_line(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", pages.first_line("text").alias("first_line"))


@register("first_n_posts")
def q_first_n_posts(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return pages.first_n(c, ["conv_id"], [F.col("turn")], TURNS_PER_CONV)


@register("zip_posts")
def q_zip_posts(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    users = c.where(F.col("role") == "user").withColumnRenamed("text", "prompt")
    bots = c.where(F.col("role") == "assistant").withColumnRenamed("text", "reply")
    return pages.zip_lists(users, bots, ["conv_id"], [F.col("turn")], [F.col("turn")],
                           "prompt", "reply")
