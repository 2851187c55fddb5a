"""The index as a stream's sink: pages arrive as files, their papers' chunks are replaced.

The index is dealt into buckets by paper.  A micro-batch writes the buckets it touches anew, as
a version of its own, and then a manifest that names the version of every bucket, so readers see
whole versions only, what isn't touched isn't rewritten, and a batch that runs again after a
failure replaces its own version.  What is ingested twice changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvellum.operators import chunking
from corvellum.session import checkpointed, new_folder
from corvellum.sources.tables import latest

#: Buckets of an index; a parameter, to be set by the size of the corpus.
BUCKETS = 64
PAGES = "paper_id string, page int, text string, parsed_at timestamp_ntz"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, index: str) -> list[int]:
    fs, at = _files(spark, index)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, index: str, before: int | None = None) -> dict[int, int]:
    """The version that holds each bucket, of the newest whole version (below `before`)."""
    done = [v for v in _manifests(spark, index) if before is None or v < before]
    if not done:
        return {}
    text = spark.read.text(f"{index}/manifest-{done[-1]}.json", wholetext=True).first().value
    return {int(b): v for b, v in json.loads(text).items()}


def _read(spark: SparkSession, index: str, held: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{index}/version-{v}/bucket={b}" for b, v in sorted(held.items())]) if held else None


def read_index(spark: SparkSession, index: str) -> DataFrame | None:
    """The newest whole version, or None before the first chunk."""
    return _read(spark, index, manifest(spark, index))


def apply_batch(pages: DataFrame, version: int, index: str, papers: DataFrame, strategy: str, buckets: int = BUCKETS) -> None:
    """Replace the chunks of the batch's papers; all pages of a paper come in one batch."""
    spark = pages.sparkSession
    of = F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int").alias("bucket")
    ingested = pages.select("paper_id").distinct()
    touched = [r.bucket for r in ingested.select(of).distinct().collect()]  # at most `buckets`
    new = chunking.chunks(latest(pages, ["paper_id", "page"], "parsed_at"), papers, strategy)
    held = manifest(spark, index, version)
    before = _read(spark, index, {b: held[b] for b in touched if b in held})
    merged = new if before is None else before.join(ingested, "paper_id", "left_anti").unionByName(new)
    merged = checkpointed(merged.withColumn("bucket", of))
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/version-{version}")
    filled = [r.bucket for r in merged.select("bucket").distinct().collect()]
    held = {b: v for b, v in held.items() if b not in touched} | {b: version for b in filled}
    fs, at = _files(spark, f"{index}/manifest-{version}.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()


def ingest_stream(spark: SparkSession, source: str, index: str, checkpoint: str, papers: DataFrame, strategy: str = "section_context") -> StreamingQuery:
    """Ingest the page files that are new since the last run, then stop."""
    stream = spark.readStream.schema(PAGES).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, index, papers, strategy)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; a table may be a folder or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, at = _files(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; with a watermark, so that state is bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))


def sessions(events: DataFrame, pause: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Visits of each user that a pause ends, as they close."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", pause), "user_id").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows of an events table, computed as a stream over its files.

    The result has a row a window and type and goes to the shared folder, not the driver.
    """
    out = new_folder(spark, "event-windows")
    stream = table_stream(spark, path)
    query = windowed(stream).writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("began"), "event_type", "n", "max_value")
