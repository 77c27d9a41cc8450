"""Results kept in shared storage: bucketed tables of lookups by key, and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir``, so that readers do not compute it anew.

    Only on a local master, where none is set, a temporary folder is taken; on a cluster that raises ``ValueError``.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", "") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridfold-checkpoint-"))
    return df.checkpoint(eager=True)


def stage_keyed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table of the warehouse in ``buckets`` files by ``key``, in its order; an earlier one is replaced.

    A join on the key shuffles only its other side. Take as many buckets as shuffle partitions or more.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)
