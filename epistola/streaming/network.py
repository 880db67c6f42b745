"""The network's statistics as streams: node and edge aggregates over a growing document folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from epistola.operators import network
from epistola.operators.headers import header_filter, parse_messages


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parsed messages of the documents that arrive in a Parquet folder; a single file is watched for in its folder."""
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        reader = reader.option("pathGlobFilter", path.getName())
        folder = folder.rsplit("/", 1)[0]
    docs = reader.parquet(folder)
    return parse_messages(docs.where(header_filter()))


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    return network.edge_stats(message_stream(spark, folder))


def node_stream(spark: SparkSession, folder: str) -> DataFrame:
    return network.node_stats(message_stream(spark, folder))


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there now, into an in-memory table of its complete result."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
