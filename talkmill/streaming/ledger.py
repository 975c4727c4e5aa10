"""A ledger fed by a stream: each key is written once, however often a batch is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from talkmill.operators.stores import append_new


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Starts a query that appends the stream's new keys to the Parquet ledger at path, until what is there has been read."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).option("recursiveFileLookup", True).parquet(path) if exists(spark, path) else batch.limit(0)
        append_new(old.limit(0), batch, key, order).join(old.select(*key).distinct(), key, "left_anti").write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
