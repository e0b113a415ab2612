"""Weekly counts of a stream of events, late ones included up to a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import shared_dir


def weekly_counts(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """stream(ts timestamp, ...) to (week_start, n_events); weeks start on Monday UTC. In update and append mode rows of weeks that the watermark has closed are dropped, and so is the state of these weeks."""
    week = F.window("ts", "7 days", startTime="4 days")  # 1970-01-05 was a Monday
    return stream.withWatermark("ts", late).groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("week.start").alias("week_start"), "n_events")


def run_available(spark: SparkSession, source: str, schema, name: str, late: str = "14 days") -> DataFrame:
    """Reads a parquet file, or all those of a folder, as a stream, file by file, until none is left; the counts are those of the last update."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if not folder:  # streams read folders: take the one that holds the file, and of it only that
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(source).select(F.col("ts").cast("timestamp").alias("ts"))
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")  # a batch that is run again replaces itself

    query = weekly_counts(stream, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    # of each week the count of its last update
    rows = spark.read.schema("week_start timestamp, n_events long, batch long").parquet(f"{out}/counts")
    return rows.groupBy("week_start").agg(F.max_by("n_events", "batch").alias("n_events"))
