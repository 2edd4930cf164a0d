"""Incremental site counts and summaries: files of calls arrive, their states are appended, merged now and then, and read as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandlake.operators.sites import finalize_summary, merged_summary, site_counts, summary_states, summed_counts
from strandlake.streaming.log import StateLog


def stream_states(calls: DataFrame, log: StateLog, state: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start a query that adds the state of each micro-batch to ``log``.

    A batch costs what it holds and its share of merging, however many came before: states are mergeable, so
    the stream keeps none itself. The checkpoint resumes after the last finished batch, and the log passes over
    one that runs again. There is no event time, hence no watermark.
    """
    return calls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: log.add(state(batch), number)).start()


def counts_log(spark: SparkSession, out: str, by: tuple[str, ...] = ("sample",), fan: int = 8) -> StateLog:
    return StateLog(spark, out, lambda states: summed_counts(states, by), fan)


def summary_log(spark: SparkSession, out: str, fan: int = 8) -> StateLog:
    return StateLog(spark, out, merged_summary, fan)


def stream_counts(calls: DataFrame, out: str, checkpoint: str, by: tuple[str, ...] = ("sample",)):
    return stream_states(calls, counts_log(calls.sparkSession, out, by), lambda batch: site_counts(batch, by=by), checkpoint)


def counts_so_far(spark: SparkSession, out: str, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The counts of all batches at ``out`` as one state a site."""
    return counts_log(spark, out, by).read()


def counts_of_files(spark: SparkSession, path: str, schema: T.StructType, project, out: str, checkpoint: str, files_per_batch: int = 50) -> DataFrame:
    """All files at ``path`` through the stream, ``files_per_batch`` at a time; the final counts."""
    calls = project(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
    stream_counts(calls, out, checkpoint).awaitTermination()
    return counts_so_far(spark, out)


def summary_of_files(spark: SparkSession, path: str, schema: T.StructType, project, out: str, checkpoint: str, files_per_batch: int = 50) -> DataFrame:
    """The running summary of all files at ``path``, from sketches stored with each batch."""
    calls = project(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
    log = summary_log(spark, out)
    stream_states(calls, log, summary_states, checkpoint).awaitTermination()
    return finalize_summary(log.read())
