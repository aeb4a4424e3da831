"""Plan-shape helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``name`` = ``expr`` evaluated exactly once per row.

    Catalyst collapses adjacent projections and pushes filters through them
    by substituting the expression for its alias.  That is right for cheap
    expressions, but a tokenizer (regex over a whole text) substituted into
    a lambda or a pushed-down filter runs once per array element or twice
    per row.  A one-row ``inline`` generator produces the column instead:
    generated columns are neither inlined into later projections nor pushed
    below the generator.
    """
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))
