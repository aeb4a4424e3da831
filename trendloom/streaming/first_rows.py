"""ST2 in event time: the first n collected rows by (created_at, id), in whatever
order their files arrive.

The rows that may still be among the first n are a table of at most n rows.  Each
micro-batch merges its own first n rows with it and writes the result as the version of
that batch, from the newest version of an earlier batch, so a replayed batch makes the
same version again.  A drained stream therefore gives the exact first n of all
that was read.  A status is taken to be at most ``delay`` late: once the latest time
seen is further than that beyond the n-th row, the rows are final and the query
stops.  Only n, the times and counts reach the driver.
"""

from __future__ import annotations

import re
import time
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trendloom.schemas import COLLECTED
from trendloom.sources.files import CORRUPT, stream_statuses
from trendloom.sources.sinks import batch_versions
from trendloom.streaming.collect import _written, collect_batch, limited
from trendloom.streaming.listing import AssetListing, landed_once

LEDGER = "n long, last timestamp_ntz, latest timestamp_ntz"  # rows held, time of the last, latest time read


def _version(sink: str, part: str, batch_id: int) -> str:
    return f"{sink.rstrip('/')}/{part}/batch_id={batch_id}"


def _newest(spark: SparkSession, sink: str, before: int | None = None) -> int | None:
    """The newest complete version (its ledger is written last), of a batch earlier than ``before``."""
    found = [b for b in batch_versions(spark, f"{sink.rstrip('/')}/ledger") if before is None or b < before]
    return max(found, default=None)


def read_first_rows(spark: SparkSession, sink: str, batch_id: int | None = None) -> DataFrame:
    """The rows held after the newest batch (or after ``batch_id``)."""
    b = _newest(spark, sink) if batch_id is None else batch_id
    if b is None:
        return spark.createDataFrame([], COLLECTED)
    return spark.read.schema(COLLECTED).parquet(_version(sink, "rows", b))


def _state(spark: SparkSession, sink: str, batch_id: int | None):
    """(n, last, latest) as of a batch."""
    if batch_id is None:
        return 0, None, None
    return tuple(spark.read.schema(LEDGER).parquet(_version(sink, "ledger", batch_id)).first())


def _seconds(delay: str) -> timedelta:
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", delay)
    if not m:
        raise ValueError(f"delay {delay!r} is not a number of seconds, minutes, hours or days")
    return timedelta(**{m[2] + "s": int(m[1])})


def run_first_rows(spark: SparkSession, source: str, sink: str, checkpoint: str, n: int,
                   assets: DataFrame | AssetListing | None = None, phrases: DataFrame | None = None,
                   delay: str | None = None, max_files_per_trigger: int | None = 1,
                   available_now: bool = True, timeout_s: float | None = None, after_batch=None) -> bool:
    """Run until the stream is drained, or the rows are final (``delay``).  A restart on the same sink
    and checkpoint goes on.  Returns whether the rows are final.  A status without a time comes first,
    as nulls do in the order; lines that cannot be parsed are not rows."""
    late = None if delay is None else _seconds(delay)

    def final(state) -> bool:
        held, last, latest = state
        return late is not None and held >= n and (last is None or last < latest - late)

    if final(_state(spark, sink, _newest(spark, sink))):
        return True
    own = landed_once(spark, assets) if isinstance(assets, DataFrame) else None
    listing = own or assets
    phrases = _written(spark, phrases)
    done = [False]

    def per_batch(batch: DataFrame, batch_id: int):
        before = _newest(spark, sink, batch_id)
        state = _state(spark, sink, before)
        if final(state):
            done[0] = True
            return
        batch = batch.persist()
        try:
            good = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            rows = collect_batch(good, None if listing is None else listing.media(), phrases).drop("_photos")
            held = limited(rows, n, False)
            if before is not None:
                held = limited(held.unionByName(read_first_rows(spark, sink, before)), n, False)
            obs = Observation(f"first_rows_{batch_id}")
            (held.observe(obs, F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
             .write.mode("overwrite").parquet(_version(sink, "rows", batch_id)))
            latest = good.agg(F.max("created_at")).first()[0]
        finally:
            batch.unpersist()
        latest = max((t for t in (latest, state[2]) if t is not None), default=None)
        now = (int(obs.get["n"] or 0), obs.get["last"], latest)
        (spark.createDataFrame([now], LEDGER).coalesce(1).write.mode("overwrite")
         .parquet(_version(sink, "ledger", batch_id)))
        if after_batch is not None:
            after_batch(batch_id)
        done[0] = final(now)

    w = (stream_statuses(spark, source, max_files_per_trigger).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint))
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()
    began = time.time()
    try:
        while q.isActive and not done[0]:
            if timeout_s is not None and time.time() - began > timeout_s:
                raise TimeoutError("the stream of first rows did not finish")
            q.awaitTermination(0.2)
    finally:
        if q.isActive:
            q.stop()
        if own is not None:
            own.drop()
    if q.exception() is not None and not done[0]:
        raise q.exception()
    return done[0]
