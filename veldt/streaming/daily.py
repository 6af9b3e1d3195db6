"""Structured Streaming jobs.

``daily_stream``: a file source of landed daily measurements drives
``foreachBatch``; each micro-batch (1) suppresses duplicate (entity, day)
rows and appends only unseen keys to the measurement store (I3, S3),
(2) reads the store for [min(batch) - 90, max(batch) + 90], the trailing
state every affected day needs (I2), (3) writes recomputed serving features
for every day the batch can influence (S4, I5) and (4) scores them with a
stored pipeline (I1, J11).  Late or out-of-order files therefore converge to
exactly the batch result.

Tables are partitioned by month and batch id.  Reads name the months they
need, so neither the anti-join nor the history scans the whole store; a batch
overwrites exactly its own partitions, and a row in ``commits`` ends it.  A
batch that was killed half-way is replayed by Spark with the same files and
the same id, sees no row of its own, and writes nothing twice.

``event_counts_stream``: event-time daily (and sliding 7-day) counts with
duplicates suppressed within the watermark and rows behind it dropped; state
is bounded by the watermark, update mode merged by ``foreachBatch`` (I3, I9).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt import config as C
from veldt.operators import merge as M
from veldt.operators import serving as SV
from veldt.operators.ml import Scorer
from veldt.session import scratch_path

MEASURE_SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("entity_id", T.IntegerType()),
    T.StructField("ecosystem", T.StringType()), T.StructField("ecosystem_id", T.IntegerType()),
    T.StructField("dry_months", T.ArrayType(T.IntegerType())), T.StructField("day", T.DateType()),
    T.StructField("precipitation", T.DoubleType()), T.StructField("temp_max", T.DoubleType()),
    T.StructField("ndvi", T.DoubleType()), T.StructField("firms_count", T.IntegerType()),
    T.StructField("firms_frp_mean", T.DoubleType()), T.StructField("precip_units", T.LongType()),
    T.StructField("ndvi_units", T.LongType()),
])


def land(panel: DataFrame, path: str, files: int = 16) -> None:
    """Write daily measurements as landed parquet files (one job, ~``files`` files)."""
    (panel.select(*[f.name for f in MEASURE_SCHEMA.fields])
          .repartition(files, F.date_trunc("month", "day"))
          .write.mode("append").parquet(path))


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)  # not written yet; any other error of a read is raised


def _write(df: DataFrame, base: str, name: str, batch_id: int) -> None:
    """Rows of one batch, under their months; a replay replaces them."""
    (df.withColumn("month", F.date_format("day", "yyyy-MM")).withColumn("batch", F.lit(batch_id).cast("bigint"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(os.path.join(base, name)))


def _commit(spark: SparkSession, base: str, batch_id: int) -> None:
    row = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"))
    row.coalesce(1).write.mode("overwrite").parquet(os.path.join(base, "commits", f"n={batch_id}"))


def _months(lo: Column, hi: Column) -> Column:
    return F.col("month").between(F.date_format(lo, "yyyy-MM"), F.date_format(hi, "yyyy-MM"))


_STORED = T.StructType([*MEASURE_SCHEMA.fields, T.StructField("month", T.StringType()), T.StructField("batch", T.LongType())])


def daily_stream(spark: SparkSession, landing: str, base: str, max_files: int = 2, history: int = C.SERVE_HISTORY_DAYS,
                 scorer: Scorer | None = None, min_rows: int = C.SERVE_MIN_ROWS) -> None:
    """Run the landed-file stream to completion, or take it up where it stopped; read the result with
    :func:`current` ("features", and "forecasts" where a scorer is given: days with at least ``min_rows`` of history, B15)."""
    keys = ["entity", "day"]

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = M.first_by(batch, keys).persist()
        try:
            lo, hi = batch.agg(F.min("day"), F.max("day")).first()     # two scalars per micro-batch
            if lo is not None:
                lo, hi = F.lit(lo), F.lit(hi)
                stored = _read_or_empty(session, os.path.join(base, "store"), _STORED)
                seen = stored.where(_months(lo, hi) & (F.col("batch") < batch_id))
                _write(M.insert_if_absent(seen, batch, keys), base, "store", batch_id)
                since, until = F.date_sub(lo, history), F.date_add(hi, history)
                hist = (session.read.schema(_STORED).parquet(os.path.join(base, "store"))
                        .where(_months(since, until) & F.col("day").between(since, until) & (F.col("batch") <= batch_id)))
                f = SV.serve_vector(SV.serve_features(hist.drop("month", "batch"))).where(F.col("day").between(lo, until))
                f = f.select("entity", "day", "history_rows", *C.FEATURE_COLS)
                _write(f, base, "features", batch_id)
                if scorer is not None:
                    _write(scorer.score(f.where(F.col("history_rows") >= min_rows)).select(*keys, *C.PROB_COLS), base, "forecasts", batch_id)
            _commit(session, base, batch_id)
        finally:
            batch.unpersist()

    src = spark.readStream.schema(MEASURE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(landing)
    q = (src.writeStream.foreachBatch(process).trigger(availableNow=True)
            .option("checkpointLocation", os.path.join(base, "_checkpoint")).start())
    q.awaitTermination()


def current(spark: SparkSession, base: str, name: str, keys=("entity", "day")) -> DataFrame:
    """Read view of a table of the stream: newest committed batch per key."""
    done = spark.read.schema("batch long").parquet(os.path.join(base, "commits", "*"))
    rows = spark.read.parquet(os.path.join(base, name)).withColumn("batch", F.col("batch").cast("bigint")).join(done, "batch", "left_semi")
    return M.latest_version(rows, list(keys), "batch").drop("batch", "month")


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def land_events(events: DataFrame, path: str, span_days: int = 3, late_by: int = 4) -> int:
    """Events as files in order of arrival, one for each ``span_days`` days, to feed the stream with
    what sources do: every tenth event comes again in the next file, and every fortieth of the first
    days only ``late_by`` files later.  Returns the number of files."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()  # two scalars
    files = (last.date() - first.date()).days // span_days + 1
    chunk = F.floor(F.datediff(F.col("ts").cast("date"), F.lit(first.date())) / span_days)
    late = (F.pmod("event_id", F.lit(40)) == 7) & (chunk + late_by < files)
    again = (F.pmod("event_id", F.lit(10)) == 3) & ~late & (chunk + 1 < files)
    arrivals = F.when(late, F.array(chunk + late_by)).when(again, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = events.withColumn("_file", F.explode(arrivals)).persist()
    try:
        for k in range(files):  # one after the other: the stream takes files by age
            rows.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    finally:
        rows.unpersist()
    return files


def event_counts_stream(spark: SparkSession, landing: str, base: str, watermark: str = "1 day",
                        window: str = "1 day", slide: str | None = None, max_files: int = 1) -> dict:
    """Event-time counts per (window, event_type), each event id once within the watermark.

    Update mode emits changed windows each micro-batch; ``foreachBatch`` writes them under the batch
    id and readers keep the newest version.  Event times are wall-clock UTC (TIMESTAMP_NTZ); they are
    counted from the epoch, so the session's time zone does not matter.  Returns ``out`` (the folder)
    and, from the progress reports that Spark keeps, ``landed`` rows and ``dropped`` ones (behind
    the watermark, or seen before)."""
    out, ckpt = os.path.join(base, "counts"), os.path.join(base, "_checkpoint_counts")
    src = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(landing)
           .withColumn("event_time", F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, ts))")))
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    agg = (M.dedupe_within_watermark(src, ["event_id"], "event_time", watermark)
              .groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")))

    def wall(side: str) -> Column:
        return F.expr(f"timestampadd(MICROSECOND, unix_micros(w.{side}), {_EPOCH})").alias(f"window_{side}")

    def merge(batch: DataFrame, batch_id: int) -> None:
        (batch.select(wall("start"), wall("end"), "event_type", "n", F.lit(batch_id).cast("bigint").alias("version"))
              .write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}")))

    q = (agg.writeStream.outputMode("update").foreachBatch(merge).trigger(availableNow=True)
            .option("checkpointLocation", ckpt).start())
    q.awaitTermination()
    reports = [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]
    # the first stateful operator is the counting one, the last (nearest to the source) the suppression
    first = [r["stateOperators"][-1] for r in reports if r["stateOperators"]]
    dropped = sum(o["numRowsDroppedByWatermark"] + o["customMetrics"].get("numDroppedDuplicateRows", 0) for o in first)
    return {"out": out, "landed": sum(r["numInputRows"] for r in reports), "dropped": dropped}


def event_counts(spark: SparkSession, out: str) -> DataFrame:
    """Newest count per (window, event_type)."""
    return M.latest_version(spark.read.parquet(os.path.join(out, "batch=*")), ["window_start", "event_type"], "version").drop("version")


def fresh_base(spark: SparkSession, name: str) -> str:
    """A new run folder under the shared checkpoint location."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")
