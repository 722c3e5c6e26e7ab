"""Streams: uploads that are ingested once, and the registry as running state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from groundstone.session import cut, forget, scratch, settled
from groundstone.sources.files import Parser, discover, identified, parsed, plain_text


def ingest_uploads(spark: SparkSession, landing: str, store: str, checkpoint: str, parser: Parser = plain_text, suffix: str = ".txt", then: Callable[[], None] | None = None) -> StreamingQuery:
    """Files that land in a folder become documents and pages of a store, each content once.

    A micro-batch leaves out what the store has, documents by hash and pages by id, and appends the
    rest, pages first: a document in the store says that its pages are whole.  A batch that is run
    again after a failure anywhere in it adds what is missing.  ``then`` runs after every batch (to
    extract and link what came).  Runs over what is there and ends.
    """

    def batch(files: DataFrame, _: int) -> None:
        new = identified(files).dropDuplicates(["content_sha256"])
        with scratch(spark):
            if (known := _maybe(spark, f"{store}/documents")) is not None:
                new = new.join(known.select("content_sha256"), "content_sha256", "left_anti")
            new = cut(new, "uploads")
            pages = parsed(new, parser)
            if (have := _maybe(spark, f"{store}/pages")) is not None:
                pages = pages.join(have.select("id"), "id", "left_anti")
            pages.write.mode("append").parquet(f"{store}/pages")
            new.drop("content").write.mode("append").parquet(f"{store}/documents")
        if then is not None:
            then()

    files = discover(spark, landing, suffix=suffix, streaming=True)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _maybe(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if settled(spark, path) else None


def running_registry(spark: SparkSession, folder: str, schema: StructType, table: str, checkpoint: str, glob: str | None = None, late: str | None = None) -> StreamingQuery:
    """Facts of a growing folder, counted by type as they come: first and last time, how many, and the
    union of their payloads' keys.

    A fact delivered again, by id, isn't counted again.  With ``late`` ids are remembered for that
    long after the newest ``created_at`` and older facts are left out, which bounds the stream's
    state; without it every id is remembered.  A micro-batch is aggregated and merged into the
    table's version before it, ``table/v=<batch>``; the last two versions stay.  A batch that is run
    again gives the same version.
    """
    reader = spark.readStream.schema(schema)
    facts = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder).where("fact_type is not null")
    facts = facts.dropDuplicates(["id"]) if late is None else facts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])

    def batch(new: DataFrame, n: int) -> None:
        times = new.groupBy("fact_type").agg(F.count("*").alias("fact_count"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
        keys = new.select("fact_type", F.explode(F.json_object_keys("payload_json")).alias("key")).distinct().groupBy("fact_type").agg(F.array_sort(F.collect_list("key")).alias("observed_keys"))
        rows = times.join(keys, "fact_type", "left").withColumn("observed_keys", F.coalesce("observed_keys", F.array().cast("array<string>")))
        before = [v for v in _versions(spark, table) if v < n]
        if before:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{table}/v={max(before)}"))
        merged = rows.groupBy("fact_type").agg(F.sum("fact_count").alias("fact_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("observed_keys")))).alias("observed_keys"))
        merged.write.mode("overwrite").parquet(f"{table}/v={n}")
        for v in before[:-1]:
            forget(spark, f"{table}/v={v}")

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Whole versions of a table, the oldest first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getParent().getName() for x in (fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/v=*/_SUCCESS")) or [])]
    return sorted(int(x.removeprefix("v=")) for x in found)


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a table that a stream wrote."""
    return spark.read.parquet(f"{table}/v={_versions(spark, table)[-1]}")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and type; those later than the watermark are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Recent micro-batches of a stream as a table: batch, rows and milliseconds (Spark keeps a hundred)."""
    rows = [(p["batchId"], p["numInputRows"], p["batchDuration"]) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch bigint, rows bigint, ms bigint").orderBy(F.desc("batch"))
