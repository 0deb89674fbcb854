"""The incremental replication at a steady pace, as a streaming query.

Spark's clock source gives the beat; each micro-batch is one pass of ``incremental_replicate``. How
far the target has come is its watermark, kept with the target's files, not an offset of
the stream: a batch that is run again after a failure, or a query that begins anew under another
checkpoint, reads the source from there on and merges what it finds, which changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tableops.plans.replicate import incremental_replicate
from tableops.sources.jdbc import JdbcSource


def stream_replicate(
    spark: SparkSession,
    source: JdbcSource,
    table: str,
    db: str,
    keys: list[str],
    ts: str,
    checkpoint: str,
    every: str = "10 minutes",
    **replicating,
) -> StreamingQuery:
    """Bring ``db.<table>`` up to date ``every`` so often, until the query is stopped.

    ``replicating`` as in ``incremental_replicate``. A pass that takes longer than the pace is followed
    at once by one more, not by all that were missed. A pass that fails ends the query; start it
    again under the same checkpoint. One query at a time may write to a target.
    """
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def one_pass(_, number: int) -> None:
        incremental_replicate(spark, source, table, db, keys, ts, **replicating)

    writer = beats.writeStream.foreachBatch(one_pass).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).queryName(f"replicate {db}.{table}").start()
