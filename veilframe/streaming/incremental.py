"""Extension: records that arrive as a stream of files, taken through a batch operator.

Each micro-batch is an ordinary DataFrame, so the loops and evaluations apply to it unchanged; the
checkpoint makes a batch that failed half-way run again, and its output folder is replaced whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.sources import jsonl


def run_on_arrival(spark: SparkSession, source: str, target: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame]):
    """Apply operator to the JSON lines of each batch of new files under source; returns the running query.

    Results are JSON lines under target/batch=<n>. It stops by itself once all present files are done.
    """
    lines = spark.readStream.format("text").load(source)

    def one(batch: DataFrame, number: int) -> None:
        jsonl.save(operator(jsonl.scan_lines(batch)), f"{target}/batch={number}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
