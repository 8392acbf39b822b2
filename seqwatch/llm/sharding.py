"""Contiguous shards of near equal byte size, from per-partition totals and prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.llm.shared import written

ROW_OVERHEAD = 16


def contiguous_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Deals all rows, in the order of doc_id, into `shards` contiguous runs of near equal bytes.

    A row weighs the UTF-8 bytes of its text plus 16. The rows are range-partitioned by id once and written with
    their partition number; one total per partition gives each partition its offset, a running sum within the
    partition does the rest. A row goes to the shard that holds the middle of its byte range, so that a shard is
    off its target by less than one row. Only (id, size, checksum) is shuffled, never the text.

    Nulls: a null text weighs 16 and has the checksum of no bytes; null ids come first. Repeated ids keep every
    row, ordered by checksum and size. A row larger than a shard's target fills its shard alone and leaves the
    neighbours empty. An empty table gives no rows. Other columns of the input are ignored.
    """
    order = ["doc_id", "text_crc32", "size"]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = (
        rows.withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(within))
        .join(F.broadcast(offsets), "part")
        .withColumn("place", F.col("rows_before") + F.col("row") - 1)
        .withColumn("shard", F.expr(f"least({shards - 1}, ((2 * (bytes_before + end) - size) * {shards}) div (2 * all_bytes))").cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    placed = written(placed, "shard-places")
    starts = placed.groupBy("shard").agg(F.min("place").alias("shard_start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("shard_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
