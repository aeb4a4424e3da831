"""The collection job as a Structured Streaming query (ST1-ST7, A12).

    statuses (JSON file stream, maxFilesPerTrigger)        ST6
      -> PERMISSIVE parse, bad lines to a rejects table   ST5
      -> foreachBatch:                                     ST1
           F2 drop retweets, F1 tracked phrases,
           J5 all photos landed (join with the bucketed asset listing),
           P1..P7 flatten to the collected table,
           exact limit (rows or photos) in arrival order   ST2
      -> idempotent write: output of batch b of a run goes to
         run_id=r/batch_id=b with overwrite, so a replayed batch replaces
         itself, and another run into the same sink is appended   ST3, U2
      -> ledger row per batch: statuses and photos read, rows and photos kept,
         and whether a status was refused

A run is a checkpoint location: its id is stored beside the checkpoint, so a
restarted query goes on as the same run after the last committed batch (ST3).
The limit is one prefix over the whole run: what earlier batches kept is read
from the ledger once when the query starts and then added up, and once the
photo limit has refused a status nothing later is let in.  ``availableNow``
drains what has arrived and stops; with any trigger the driver stops the query
when the limit is reached, and a batch that begins meanwhile returns without
reading its files (ST7).  Progress (ST4/A12) is the ledger, a table.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trendloom.operators import status as st
from trendloom.operators import track
from trendloom.schemas import COLLECTED
from trendloom.sources.files import CORRUPT, stream_statuses
from trendloom.streaming.listing import AssetListing, landed_once

PROGRESS_EVERY = 25  # report interval (rows or photos), as the reference
LEDGER = "statuses long, statuses_photos long, rows long, photos long, refused boolean"


@dataclass
class Progress:
    batches: int = 0
    rows: int = 0
    photos: int = 0
    reports: list = field(default_factory=list)


class ProgressListener(StreamingQueryListener):
    """ST4: accumulates the observed metrics of each micro-batch and keeps a
    report line each time the running count crosses a multiple of
    ``every``."""

    def __init__(self, name: str, progress: Progress, every: int = PROGRESS_EVERY):
        self.name = name
        self.progress = progress
        self.every = every

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        m = p.observedMetrics.get(self.name) if p.observedMetrics else None
        if m is None:
            return
        before = self.progress.rows
        self.progress.batches += 1
        self.progress.rows += int(m["rows"] or 0)
        self.progress.photos += int(m["photos"] or 0)
        if before // self.every != self.progress.rows // self.every:
            self.progress.reports.append(f"{self.progress.rows} statuses read")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def run_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the run whose checkpoint this is; made on its first start."""
    path = f"{checkpoint.rstrip('/')}.run"
    if not _exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run_id string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def read_ledger(spark: SparkSession, sink: str) -> DataFrame:
    """One row for each batch of each run: run_id, batch_id and the counts."""
    return (spark.read.schema(f"{LEDGER}, run_id string, batch_id long")
            .option("basePath", f"{sink.rstrip('/')}/ledger").parquet(f"{sink.rstrip('/')}/ledger"))


def read_progress(spark: SparkSession, sink: str) -> DataFrame:
    """Batches, statuses and photos read, rows and photos kept, over all
    runs into the sink."""
    return read_ledger(spark, sink).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("statuses").alias("statuses"),
        F.sum("statuses_photos").alias("photos"), F.sum("rows").alias("rows_kept"),
        F.sum("photos").alias("photos_kept"))


@dataclass
class _Kept:
    """What a run has kept so far."""
    rows: int = 0
    photos: int = 0
    refused: bool = False

    def reached(self, limit: int | None, photos_as_limit: bool) -> bool:
        if limit is None:
            return False
        return self.refused if photos_as_limit else self.rows >= limit


def _kept_before(spark: SparkSession, sink: str, run_id: str, batch_id: int | None) -> _Kept:
    if not _exists(spark, f"{sink.rstrip('/')}/ledger/run_id={run_id}"):
        return _Kept()
    ledger = read_ledger(spark, sink).where(F.col("run_id") == run_id)
    if batch_id is not None:
        ledger = ledger.where(F.col("batch_id") < batch_id)
    r = ledger.agg(F.sum("rows"), F.sum("photos"), F.bool_or("refused")).first()
    return _Kept(int(r[0] or 0), int(r[1] or 0), bool(r[2]))


def collect_batch(batch: DataFrame, assets: DataFrame | None, phrases: DataFrame | None) -> DataFrame:
    """The body shared by the stream and the batch job; ``_photos`` is the
    number of all photos of a status."""
    s = st.drop_retweets(batch)
    if phrases is not None:
        s = track.track_filter(s, phrases, "id_str", st.full_text(), few_files=True).drop("n_phrases")
    return st.collect_rows(s, assets, drop_rts=False, photos_col="_photos")


def _written(spark: SparkSession, phrases: DataFrame | None) -> DataFrame | None:
    """The tracking list's index written once, so that no batch computes it again."""
    return None if phrases is None else track.phrase_index(phrases.select("phrase"))


def limited(rows: DataFrame, left: int, photos_as_limit: bool) -> DataFrame:
    """The first rows in (created_at, id) order: ``left`` rows, or as long as
    their photos stay within ``left``."""
    rows = rows.withColumn("_id", F.col("tweet_id").cast("long"))
    if photos_as_limit:
        return st.photo_limit(rows, left, ["created_at", "_id"], F.col("_photos")).drop("photos_so_far", "_id")
    return st.row_limit(rows, left, ["created_at", "_id"]).drop("_id")


def first_deliveries(stream: DataFrame, window: str) -> DataFrame:
    """ST3: a status that is delivered again within ``window`` of its first arrival
    is left out, also across restarts on one checkpoint; state is one key for each
    status of that time.  Time is that of arrival, so nothing comes late and no other
    row is lost.  A status is known by its id, a line that cannot be parsed or has no id by its text."""
    whole = F.sha2(F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[c for c in stream.columns if c != CORRUPT]))), 256)
    known = F.col(CORRUPT).isNull() & F.col("id_str").isNotNull()
    key = F.when(known, F.concat(F.lit("id "), "id_str")).otherwise(F.concat(F.lit("text "), whole))
    return (stream.withColumn("_delivery", key).withColumn("_arrived", F.current_timestamp())
            .withWatermark("_arrived", window).dropDuplicatesWithinWatermark(["_delivery"])
            .drop("_delivery", "_arrived"))


def start_collect_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                         assets: DataFrame | AssetListing | None = None, phrases: DataFrame | None = None,
                         limit: int | None = None, photos_as_limit: bool = False,
                         max_files_per_trigger: int | None = 1, available_now: bool = True,
                         rejects: str | None = None, progress: Progress | None = None,
                         name: str = "collect", after_batch=None, redelivery: str | None = None):
    """Start the query; returns (query, state).  ``sink`` receives
    ``data/run_id=*/batch_id=*`` (collected rows) and the ledger likewise.
    The query is None if the run has reached its limit before.  ``assets`` and
    ``phrases`` are computed and written once; an ``AssetListing`` is read by each
    batch as it then is.  ``redelivery`` ("1 hour") drops what is delivered again within that time."""
    run_id = run_id_of(spark, checkpoint)
    part = lambda folder, batch_id: f"{folder.rstrip('/')}/run_id={run_id}/batch_id={batch_id}"
    state = {"done": _kept_before(spark, sink, run_id, None).reached(limit, photos_as_limit), "run_id": run_id,
             "listener": None, "listing": None}
    if state["done"]:
        return None, state
    stream = stream_statuses(spark, source, max_files_per_trigger)
    if redelivery is not None:
        stream = first_deliveries(stream, redelivery)
    if isinstance(assets, DataFrame):
        assets = state["listing"] = landed_once(spark, assets)
    phrases = _written(spark, phrases)
    stream = stream.observe(name, F.count(F.lit(1)).alias("rows"),
                            F.sum(F.size(st.photo_urls())).alias("photos"))
    lock = threading.Lock()
    kept: list[_Kept] = []  # of the batches before the next one

    def per_batch(batch: DataFrame, batch_id: int):
        with lock:
            if not kept:  # the first batch of this start; later ones add up
                kept.append(_kept_before(spark, sink, run_id, batch_id))
            so_far = kept[0]
            if so_far.reached(limit, photos_as_limit):
                state["done"] = True
                return
            # the batch is read by several branches (rejects, media check,
            # rows): materialise it once, so its files are read once.  Its
            # size is bounded by maxFilesPerTrigger.
            batch = batch.persist()
            seen = batch.agg(F.count(F.lit(1)), F.sum(F.size(st.photo_urls()))).first()
            if rejects is not None:
                bad = batch.where(F.col(CORRUPT).isNotNull()).select("id_str", CORRUPT)
                bad.write.mode("overwrite").parquet(part(rejects, batch_id))
            asked = batch.select(F.explode(st.photo_urls()).alias("media_url"))
            rows = collect_batch(batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
                                 None if assets is None else assets.media(asked), phrases)
            offered = None
            if limit is not None:
                rows = offered = rows.persist()
                rows = limited(rows, limit - (so_far.photos if photos_as_limit else so_far.rows), photos_as_limit)
            obs = Observation(f"kept_{batch_id}")  # counted while written
            (rows.observe(obs, F.count(F.lit(1)).alias("n"), F.sum("_photos").alias("p"))
             # ids and paths are hashes in hex, which only an entropy coder makes smaller
             .drop("_photos").write.mode("overwrite").parquet(part(f"{sink.rstrip('/')}/data", batch_id), compression="zstd"))
            n, photos = int(obs.get["n"] or 0), int(obs.get["p"] or 0)
            refused = offered is not None and offered.count() > n
            spark.createDataFrame([(seen[0], int(seen[1] or 0), n, photos, refused)], LEDGER).coalesce(1).write.mode(
                "overwrite").parquet(part(f"{sink.rstrip('/')}/ledger", batch_id))
            if offered is not None:
                offered.unpersist()
            batch.unpersist()
            if after_batch is not None:  # e.g. fault injection in tests
                after_batch(batch_id)
            kept[0] = _Kept(so_far.rows + n, so_far.photos + photos, so_far.refused or refused)
            state["done"] = kept[0].reached(limit, photos_as_limit)

    if progress is not None:
        state["listener"] = ProgressListener(name, progress)
        spark.streams.addListener(state["listener"])
    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start(), state


def run_collect_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                       timeout_s: float | None = None, **kw) -> dict:
    """Run until drained (availableNow) or the limit is reached (ST7: stop
    between batches).  ``timeout_s`` stops a query that takes longer; there is
    none by default.  Returns the state dict."""
    q, state = start_collect_stream(spark, source, sink, checkpoint, **kw)
    began = time.time()
    while q is not None and q.isActive:
        if state["done"]:
            q.stop()
            break
        if timeout_s is not None and time.time() - began > timeout_s:
            q.stop()
            raise TimeoutError("collection stream did not finish")
        q.awaitTermination(0.2)
    if q is not None and q.exception() is not None and not state["done"]:
        raise q.exception()
    if state["listener"] is not None:
        spark.streams.removeListener(state["listener"])
    if state["listing"] is not None:
        state["listing"].drop()
    return state


def read_collected_sink(spark: SparkSession, sink: str) -> DataFrame:
    """The collected rows written by the stream (all committed batches of all
    runs)."""
    data = f"{sink.rstrip('/')}/data"
    schema = StructType([*COLLECTED.fields, StructField("run_id", StringType()), StructField("batch_id", LongType())])
    return spark.read.schema(schema).option("basePath", data).parquet(data).drop("run_id", "batch_id")
