"""Event-log folds (2.K), batch and Structured Streaming.

Ledger records: ``(id, ts, phase, cwd, db_path, exit_code, session, forget)``
with ``phase`` in start/end; anything else is a malformed line and skipped.

* ``fold``: one row per id that has a start -- running until its end; the end
  fills ``exit_code`` and, when the start had none, ``db_path``; an end
  without a start is ignored; of a repeated start the first counts.  Batch: one ``groupBy(id)`` of conditional
  aggregates.  Stream: a state processor keyed by buckets of ids with an event-time
  timer, so state is dropped once the watermark passes a run's start by ``max_run``.
* ``active_keys``: distinct keys, most recent first, hidden when the last
  touch is not after the last forget.
* ``history``: the last N records, newest last (top-k, not a sort).
* ``activity``: per (session, tile) counters and last time.
* ``stream_profile``: per-key counts maintained by ``foreachBatch``; a new
  version is written only when the digest of the counts changed.
* ``profile_log``: the same counts as a log in which a batch writes the keys it touched and no others.
"""
from __future__ import annotations

import os
import pickle
from typing import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tablescope.functions.formats import epoch_micros
from tablescope.session import ship_package
from tablescope.sources.keyedlog import COMMIT, KeyedLog

PHASES = ("start", "end")
FOLD_SCHEMA = ("id long, started timestamp_ntz, ended timestamp_ntz, running boolean, "
               "exit_code int, db_path string, cwd string, session string")


def valid_records(ledger: DataFrame) -> DataFrame:
    """Start and end records; ``forget`` tombstones (if the ledger has the column) are no phases of a run."""
    kept = ledger.where(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("phase").isin(*PHASES))
    return kept.where(~F.coalesce(F.col("forget"), F.lit(False))) if "forget" in ledger.columns else kept


def fold(ledger: DataFrame) -> DataFrame:
    """K1 batch fold: (id, started, ended, running, exit_code, db_path, cwd, session)."""
    v = valid_records(ledger)
    is_s, is_e = F.col("phase") == "start", F.col("phase") == "end"
    g = v.groupBy("id").agg(
        F.min(F.when(is_s, F.col("ts"))).alias("started"),
        F.max(F.when(is_e, F.col("ts"))).alias("ended"),
        F.max_by(F.when(is_e, F.col("exit_code")), F.when(is_e, F.col("ts"))).alias("exit_code"),
        F.min_by(F.when(is_s, F.col("db_path")), F.when(is_s, F.col("ts"))).alias("start_db"),
        F.max_by(F.when(is_e, F.col("db_path")), F.when(is_e, F.col("ts"))).alias("end_db"),
        F.min_by(F.when(is_s, F.col("cwd")), F.when(is_s, F.col("ts"))).alias("cwd"),
        F.min_by(F.when(is_s, F.col("session")), F.when(is_s, F.col("ts"))).alias("session"))
    return g.where(F.col("started").isNotNull()).select(
        "id", "started", "ended", F.col("ended").isNull().alias("running"), F.col("exit_code").cast("int").alias("exit_code"),
        F.coalesce("start_db", "end_db").alias("db_path"), "cwd", F.col("session").cast("string").alias("session"))


def active_keys(touches: DataFrame, key: str = "key", ts: str = "ts", forget: str = "forget") -> DataFrame:
    """K2  (key, last_touch): keys whose last touch is after their last forget."""
    g = touches.groupBy(F.col(key).alias("key")).agg(
        F.max(F.when(~F.col(forget), F.col(ts))).alias("last_touch"),
        F.max(F.when(F.col(forget), F.col(ts))).alias("last_forget"))
    return g.where(F.col("last_touch").isNotNull() &
                   (F.col("last_forget").isNull() | (F.col("last_touch") > F.col("last_forget")))).select("key", "last_touch")


def history(records: DataFrame, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """K3  The last ``n`` records (top-k by time), newest last."""
    return records.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n).orderBy(ts, tie)


def activity(events: DataFrame, session: str, tile: str, kind: str, ts: str,
             kinds: Sequence[str] = ("view", "zoom", "explore")) -> DataFrame:
    """K4  Per (session, tile): one count per kind and the last time."""
    return events.groupBy(F.col(session).alias("session"), F.col(tile).alias("tile")).agg(
        *[F.count_if(F.col(kind) == k).alias(f"{k}s") for k in kinds], F.max(F.col(ts)).alias("last_ts"))


# ---- streaming ----

class RunFold(StatefulProcessor):
    """State of a bucket of runs: of each id the earliest start (if seen) and the latest end (if seen), and the one timer
    that is due first.  A call to the state store costs a message to the JVM; a bucket reads and
    writes all its runs by one, so the calls follow the buckets and not the runs.

    An end may arrive before its start, and a finished run may start or end again in a later
    micro-batch, so both wait in state until the watermark passes start (or end) + max_run."""
    STATE = "runs binary, due long"
    OUT = "id long, started long, ended long, running boolean, exit_code int, db_path string, cwd string, session string"

    def __init__(self, max_run_ms: int):
        self.max_run_ms = max_run_ms

    def init(self, handle) -> None:
        self.handle, self.bucket = handle, handle.getValueState("bucket", self.STATE)

    @staticmethod
    def _row(run, st) -> Row:
        started, db_path, cwd, session, ended, exit_code, end_db = st
        return Row(id=run, started=started, ended=ended, running=ended is None, exit_code=exit_code,
                   db_path=end_db if db_path is None else db_path, cwd=cwd, session=session)

    def _due(self, st) -> int:
        return (st[0] if st[0] is not None else st[4]) // 1000 + self.max_run_ms

    def _held(self) -> tuple[dict[int, list], int | None]:
        held = self.bucket.get()
        return ({}, None) if held is None else (pickle.loads(held[0]), held[1])

    def _hold(self, runs: dict[int, list], due: int | None) -> None:
        """Keep these runs; ``due`` is the timer that is set now (None: it has fired, or there was none)."""
        first = min(map(self._due, runs.values()), default=None)
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is None:
            self.bucket.clear()
        else:
            self.bucket.update((pickle.dumps(runs), first))
            if due != first:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        runs, due = self._held()
        touched: dict[int, list] = {}
        for r in rows:
            st = touched.get(r.id)
            if st is None:
                st = touched[r.id] = runs.pop(r.id, None) or [None] * 7
            if r.phase == "start" and (st[0] is None or r.at < st[0]):
                st[0:4] = r.at, r.db_path, r.cwd, r.session
            elif r.phase == "end" and (st[4] is None or r.at >= st[4]):
                st[4:7] = r.at, r.exit_code, r.db_path
        watermark = timerValues.getCurrentWatermarkInMs()
        runs.update((run, st) for run, st in touched.items() if self._due(st) > watermark)
        self._hold(runs, due)
        for run, st in touched.items():
            if st[0] is not None:               # an end whose start has not come is ignored
                yield self._row(run, st)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        runs, _ = self._held()
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = {run: st for run, st in runs.items() if self._due(st) <= until}
        self._hold({run: st for run, st in runs.items() if run not in gone}, None)
        for run, st in gone.items():
            if st[0] is not None and st[4] is None:   # a run that never ended: its last word
                yield self._row(run, st)

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: buckets that the runs are dealt to by the hash of their id: a bucket is one row of state
BUCKETS = 16_384


def fold_stream(ledger_stream: DataFrame, watermark: str = "1 hour", max_run_ms: int = 24 * 3600 * 1000,
                buckets: int = BUCKETS) -> DataFrame:
    """K1 streaming fold (update mode): one output row per id touched in a
    micro-batch with its current fold; late records beyond the watermark are
    dropped by Spark; the state of a run, finished or not, is evicted by an event-time timer once the
    watermark passes ``start + max_run``.  A micro-batch rewrites the state of the buckets it touches; ``buckets`` is
    fixed with the first batch of a checkpoint.  State with timers needs the RocksDB state store, which is
    set on the session."""
    ledger_stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    naive = isinstance(ledger_stream.schema["ts"].dataType, T.TimestampNTZType)
    v = (valid_records(ledger_stream).withColumn("at", epoch_micros(F.col("ts"), T.TimestampNTZType() if naive else T.TimestampType()))
         .select("id", F.timestamp_micros("at").alias("ts"), "at", "phase", "db_path", "cwd", F.col("session").cast("string").alias("session"),
                 F.col("exit_code").cast("int").alias("exit_code")).withWatermark("ts", watermark))
    out = v.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("bucket").transformWithState(RunFold(max_run_ms), RunFold.OUT, "update", "EventTime")
    at = lambda c: (F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) if naive
                    else F.timestamp_micros(c)).alias(c)
    return out.select("id", at("started"), at("ended"), "running", "exit_code", "db_path", "cwd", "session")


def _published(spark: SparkSession, out_dir: str) -> list[int]:
    """Batch ids of the complete versions under ``out_dir``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stream_profile(spark: SparkSession, source: DataFrame, key: str, value: str, out_dir: str,
                   checkpoint: str) -> str | None:
    """K5  Per-key (n, total) maintained across micro-batches with ``foreachBatch``: a batch adds its
    partial counts to the newest version of an earlier batch and is published as ``<out_dir>/v<batch id>``
    only when the digest changed.  All state lies in those folders, so a restart goes on
    from them, and a batch that is replayed overwrites its own version instead of counting twice.
    Returns the newest version's path (None before any row came)."""
    digest = F.sum(F.xxhash64("key", "n").cast("decimal(38,0)")).alias("d")

    def merge(batch: DataFrame, batch_id: int):
        merged = batch.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value)).alias("total"))
        before = None
        earlier = [v for v in _published(spark, out_dir) if v < batch_id]
        if earlier:
            old = spark.read.parquet(os.path.join(out_dir, f"v{earlier[-1]}"))
            before = old.agg(digest).first()["d"]
            merged = old.unionByName(merged).groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        if merged.agg(digest).first()["d"] != before:   # else nothing moved: publish nothing
            merged.write.mode("overwrite").parquet(os.path.join(out_dir, f"v{batch_id}"))

    q = (source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    versions = _published(spark, out_dir)
    return os.path.join(out_dir, f"v{versions[-1]}") if versions else None


PROFILE = "key string, n long, total double"


def profile_log(spark: SparkSession, source: DataFrame, key: str, value: str, log_dir: str, checkpoint: str,
                compact_every: int = 16) -> DataFrame:
    """K5  Per-key (n, total) across micro-batches, as a ``KeyedLog`` of deltas: a batch commits the counts of the
    keys it touched under its batch id, so its write follows its keys and not the profile; a batch that is
    replayed changes nothing; every ``compact_every`` batches the log is summed into a new base and older folders
    are dropped.  Returns ``profile_rows`` of the log."""
    log = KeyedLog(spark, log_dir, PROFILE)

    def publish(batch: DataFrame, batch_id: int):
        touched = batch.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value)).cast("double").alias("total"))
        if log.commit(batch_id, touched) and (batch_id + 1) % compact_every == 0:
            log.compact(_profile_sums)

    q = source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return profile_rows(log)


def _profile_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(COMMIT).alias(COMMIT))


def profile_rows(log: KeyedLog) -> DataFrame:
    """(key, n, total): the profile that the log's commits add up to."""
    return _profile_sums(log.rows()).drop(COMMIT)


def run_fold_stream(spark: SparkSession, ledger_dir: str, schema, out_dir: str, checkpoint: str,
                    watermark: str = "3650 days", files_per_trigger: int = 1) -> DataFrame:
    """Drive ``fold_stream`` over a directory of ledger files to completion
    (``availableNow``) and return the final fold: each micro-batch's updates
    are appended with their batch id, and the last update per id wins."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(ledger_dir))
    ship_package(spark)
    updates = fold_stream(stream, watermark=watermark)

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_dir)

    q = (updates.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    allu = spark.read.parquet(out_dir)
    cols = [c for c in allu.columns if c not in ("id", "batch_id")]
    last = allu.groupBy("id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return last.select("id", "s.*")
