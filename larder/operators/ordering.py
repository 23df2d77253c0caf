"""Global ordering helpers that never funnel the table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.tables import stored


def global_row_number(df: DataFrame, key: str, out: str = "rn") -> DataFrame:
    """0-based row number over the whole table ordered by a unique ``key``.

    A ``row_number()`` window without partitioning sorts everything in one task. Instead the rows are range-partitioned and
    sorted by key, stamped with their partition and their place in it, and written once; the rows per partition (one
    small aggregate) and the numbered rows are both read from that stored copy. Planning the two as separate branches over
    the exchange would draw the range bounds twice, and rows would meet offsets that are not theirs.
    """
    ranged = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(
        "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    kept = stored(ranged, "numbered").withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded side, safe to order in one task and broadcast
    offsets = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).select("_pid", "_off")
    return (kept.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_mid", "_pos", "_off"))


def fixed_size_groups(df: DataFrame, key: str, size: int) -> DataFrame:
    """(group, idx): consecutive runs of ``size`` rows in key order, idx from 0."""
    numbered = global_row_number(df, key, "_rn")
    return (numbered.withColumn("group", F.floor(F.col("_rn") / size))
            .withColumn("idx", (F.col("_rn") % size).cast("int")).drop("_rn"))
