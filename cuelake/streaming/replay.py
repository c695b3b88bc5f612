"""Run a streaming query over a table, in event order and several micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.ordered import div
from cuelake.plans.cut import durable, shared_folder
from cuelake.streaming.tracks import use_rocksdb


def replay(table: DataFrame, order: str, transform, mode: str = "append", slices: int = 2, arrival: Column | None = None) -> DataFrame:
    """Rows that ``transform`` (stream to stream) gives for the table's rows in slices.

    Slices are equal spans of ``order``, or what ``arrival`` (0 to slices - 1) says.  Each slice is staged in the
    session's shared folder and taken in by a run of the query that continues from the checkpoint of the run before.
    More slices make smaller micro-batches.  In update mode the result holds the latest row per first column.  An empty
    table gives no rows.  The stream has a session of its own, so settings of the caller's stay as they are; its state
    gets no more partitions than there are cores, because every partition keeps a store.
    """
    spark = table.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = durable(table)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if arrival is None:
        arrival = div(F.col(order) - F.lit(low), max(1, ((high or 0) - (low or 0)) // slices + 1))
    number = F.coalesce(arrival.cast("int"), F.lit(0))

    own = spark.newSession()
    use_rocksdb(own)
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for name, value in (("spark.sql.shuffle.partitions", partitions), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        own.conf.set(name, value)
    if rows.isEmpty():
        rows.write.parquet(f"{folder}/in")
        return spark.createDataFrame([], transform(own.readStream.schema(rows.schema).parquet(f"{folder}/in")).schema)
    schema = _run_slices(own, rows, number, slices, folder, transform, mode)
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{folder}/out")
    out = spark.read.parquet(f"{folder}/out")
    key, *values = schema.names
    return out.groupBy(key).agg(*[F.max_by(c, "_batch").alias(c) for c in values])


def _run_slices(spark, rows, number, slices, folder, transform, mode):
    def write_updates(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    for piece in range(slices):
        rows.where(number == piece).write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        if mode == "append":
            run = writer.outputMode(mode).format("parquet").option("path", f"{folder}/out").start()
        else:
            run = writer.outputMode(mode).foreachBatch(write_updates).start()
        run.awaitTermination()
    return stream.schema
