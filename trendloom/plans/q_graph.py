"""Registered follower-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import graph
from trendloom.plans.catalog import register
from trendloom.sources import derived

# fixed parameters of the registered queries (FIXTURES.md): seed 1, cap 2
SEED = 1
CAP = 2
PHOTOS_PER_USER = 3
BUDGET = 40
FOLLOW_N = 3


def spread_order():
    """Neighbour order for the cap: (dst*31 + src*17) % 151, then dst."""
    return [(F.col("dst") * 31 + F.col("src") * 17) % 151]


@register("cap_neighbours")
def q_cap_neighbours(spark, sf):
    return graph.cap_neighbours(derived.edges(spark, sf), CAP, spread_order())


@register("snowball_depths")
def q_snowball_depths(spark, sf):
    return graph.snowball(derived.edges(spark, sf), SEED, CAP, spread_order()).select(
        "user_id", "depth")


@register("user_images")
def q_user_images(spark, sf):
    return graph.user_images(derived.nested_statuses(spark, sf), PHOTOS_PER_USER)


@register("snowball_sample")
def q_snowball_sample(spark, sf):
    return graph.snowball_sample(derived.edges(spark, sf), derived.nested_statuses(spark, sf),
                                 SEED, BUDGET, PHOTOS_PER_USER, CAP, spread_order()).select(
        "user_id", "depth", "visit_order", "n_images", "images_before")


@register("follow_list")
def q_follow_list(spark, sf):
    e = derived.edges(spark, sf)
    return (graph.follow_list(e, "followers", FOLLOW_N, spread_order())
            .unionByName(graph.follow_list(e, "following", FOLLOW_N, spread_order())))
