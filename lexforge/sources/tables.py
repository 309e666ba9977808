"""Small tables dealt over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where its scan has fewer parts than there are cores.

    A file of one row group is one task however many cores there are.  A part of a scan holds ``spark.sql.files.maxPartitionBytes``
    or one row group, so with fewer parts than cores no core sends or gets more than about that, whatever the size of the
    cluster; a table of more parts is left as it is.  Only rows move: no result depends on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
