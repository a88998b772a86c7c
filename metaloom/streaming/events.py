"""Events as a stream: landed once each, counted in windows of event time, and folded into observations.

What events say does not depend on their order, so no watermark is needed for right results. Landing has none: what
has landed is told by the digests in the landed folder, however late an event comes. The watermark of windows bounds
their state, and that of once() the state of its duplicate check; rows later than they allow are dropped there and
nowhere else.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.documents import documents_in, get, members, text
from ..operators import conflicts
from ..shared import stored

#: Buckets of landed events by digest; folders that are there depend on it.
BUCKETS = 64


def read_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Lineage events of a folder to which files are added: event (JSON text), digest, event_time. A file holds one
    event or an array of them."""
    rows = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).text(path)
    each = rows.select(F.explode(documents_in("value")).alias("event"))
    return each.select("event", F.sha2(F.col("event").cast("binary"), 256).alias("digest"), F.try_to_timestamp(text(get(members(F.col("event")), "eventTime"))).alias("event_time"))


def once(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each event once, also if its copies arrive up to the delay apart."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["digest"])


def land(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends events to a Parquet folder, each once, in whatever order and however late they come; reads what is there
    and ends.

    Rows are partitioned by the micro-batch that landed them and by a bucket of their digest, so that a micro-batch
    meets the digests of its own buckets alone; one that runs again replaces its rows. One query at a time writes a
    folder. A folder of Spark's own streaming sink is refused, as readers would not see what is added to it.
    """
    spark = events.sparkSession
    log = spark._jvm.org.apache.hadoop.fs.Path(folder, "_spark_metadata")
    if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        raise ValueError(f"{folder} was written by a streaming sink: land its events in a new folder")
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int")

    def add(batch: DataFrame, number: int) -> None:
        own = f"{name}-{number}"
        new = stored(batch.dropDuplicates(["digest"]).withColumn("bucket", bucket), "events")
        known = _landed(spark, folder)
        if known is not None:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most so many as there are buckets
            known = known.filter((F.col("batch") != own) & F.col("bucket").isin(touched)).select(F.col("digest").alias("known"))
            new = new.join(known, F.col("digest").eqNullSafe(F.col("known")), "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={own}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _landed(spark: SparkSession, folder: str) -> DataFrame | None:
    """digest, batch and bucket of what has landed; None if nothing has."""
    try:
        return spark.read.schema("digest string, batch string, bucket int").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def counts(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by window of event time and kind of producer; a window is complete once the watermark has passed it."""
    producer = F.coalesce(text(get(members(F.col("event")), "producer")), F.lit(""))
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", window), producer.alias("producer")).agg(F.count(F.lit(1)).alias("n_events"))


def fold_observations(observations: DataFrame, folder: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Merges a stream of observations into normalized ones in folder, one version for each micro-batch.

    The state is partitioned by a hash of the object; a micro-batch rewrites only the buckets that it touches, into a
    new version whose other buckets stay where they are. A micro-batch that runs again writes the same version again.
    """
    spark = observations.sparkSession
    bucket = F.pmod(F.xxhash64("object_key"), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most so many as there are buckets
        known = latest(spark, folder, before=number)
        every = conflicts.normalize(new) if known is None else conflicts.merge(new.drop("bucket"), known.filter(F.col("bucket").isin(touched)).drop("bucket"))
        every.withColumn("bucket", bucket).withColumn("version", F.lit(number)).write.mode("overwrite").partitionBy("version", "bucket").option("partitionOverwriteMode", "dynamic").parquet(folder)
        new.unpersist()

    return observations.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest version of each bucket of folded observations (older than a version); None if there are none."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException:
        return None
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("newest"))  # partition columns: no data pages are read
    out = rows.join(F.broadcast(newest), "bucket").filter("version = newest").drop("version", "newest")
    return None if newest.isEmpty() else out
