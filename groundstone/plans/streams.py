"""Streams as queries: they run over what is there and give the table they wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.plans import sqltext as q
from groundstone.session import shared_dir
from groundstone.streaming import streams
from groundstone.tables import table


def stream_registry(spark: SparkSession, folder: str) -> DataFrame:
    """I8: the registry's counts as a stream's running state; equal to the batch's."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "facts").schema
    one_file = _is_file(spark, f"{folder}/facts.parquet")
    source, glob = (folder, "facts.parquet") if one_file else (f"{folder}/facts.parquet", None)
    streams.running_registry(spark, source, schema, f"{at}/table", f"{at}/state", glob).awaitTermination()
    return streams.latest(spark, f"{at}/table").withColumn("observed_keys", F.array_join("observed_keys", ","))


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type; the same expression runs over a stream with a watermark."""
    return streams.windowed_counts(table(spark, folder, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_registry": stream_registry, "stream_windows": stream_windows}

SQL: dict[str, str] = {
    "stream_registry": f"with {q.FACTS} select fact_type, count(*) as fact_count, min(created_at) as first_seen_at, max(created_at) as last_seen_at, (select string_agg(key, ',' order by key) from (select distinct unnest(json_keys(payload_json)) as key from facts1 x where x.fact_type = f.fact_type)) as observed_keys from facts1 f where fact_type is not null group by 1",
    "stream_windows": "select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2",
}
