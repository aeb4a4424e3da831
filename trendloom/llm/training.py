"""Bounded samples of labelled rows for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import crc_mod, free_name


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return crc_mod(doc_id, folds) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, features, max_rows: int,
                    folds: int = 5, id_col: str = "doc_id") -> list[tuple[int, bytes, float]]:
    """(id, features, label) of at most ``max_rows`` labelled documents outside
    the held-out fold: those whose ids hash lowest, so a pseudo-random sample
    that is the same in each run.  Labels given twice are averaged and count as
    1 from a half; rows without id or label are not used.  ``features`` turns
    the rows of ``docs`` into a column of bytes inside the tasks; only these
    come to the driver."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col), folds))
    i, y, x = (free_name(docs, c) for c in ("sample_id", "sample_label", "sample_features"))
    known = known.groupBy(F.col(id_col).alias(i)).agg((F.avg(label) >= 0.5).cast("double").alias(y))
    drawn = known.orderBy(F.xxhash64(i), i).limit(max_rows)
    rows = docs.join(F.broadcast(drawn), docs[id_col] == drawn[i]).select(i, features.alias(x), y)
    rows = rows.groupBy(i).agg(F.min(x).alias(x), F.first(y).alias(y))
    return sorted((r[i], bytes(r[x]), r[y]) for r in rows.collect())
