"""trendloom: a Spark-native social-text collection and trend-term engine.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregations and windows.  Jobs (``plans``)
compose operators; ``streaming`` runs the collection job as a Structured
Streaming query.
"""

__all__ = ["session", "schemas"]
