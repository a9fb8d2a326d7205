"""A stage as an incremental stream: whatever is new in a folder of rows is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.durable import exists


def run_incremental(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "image_id", files_per_batch: int = 1000) -> None:
    """Process the files that came since the last run and append the results.

    A file-source stream with ``availableNow``: it takes all new files in batches and stops; the
    checkpoint remembers what was done. Keys that ``target`` has already (rows delivered twice) are left out, so a
    batch that is repeated after a failure adds nothing twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        if exists(spark, target):  # a fault in reading it is an error: nothing is computed again by mistake
            kind = batch.schema[key].dataType.simpleString()
            rows = rows.join(spark.read.schema(f"{key} {kind}").parquet(target), key, "left_anti")
        transform(rows).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
