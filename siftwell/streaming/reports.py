"""Reports that arrive in a folder to blocks, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.segment import Layout, lines, segment


def blocks_of_new_reports(spark: SparkSession, path: str, layout: Layout, to: str, checkpoint: str) -> StreamingQuery:
    """Segment each new Parquet file of reports (report_id, text) once, and append its blocks to `to`.

    A batch that runs again overwrites its own folder, so a restart neither loses nor doubles blocks.
    """

    def write(batch: DataFrame, number: int) -> None:
        segment(lines(batch), layout).write.mode("overwrite").parquet(f"{to}/batch={number}")

    stream = spark.readStream.schema("report_id string, text string").parquet(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
