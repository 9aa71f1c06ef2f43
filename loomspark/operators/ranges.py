"""Ranges over an ordered chain: coverage, gaps, overlaps, packets and receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import Scratch


def tiles(ranges: DataFrame, key: str) -> DataFrame:
    """key, tiled: whether the ranges [start, end) of a key cover 0 to ``length`` without gap or overlap."""
    order = Window.partitionBy(key).orderBy("start", "end")
    joined = ranges.withColumn("prev", F.lag("end").over(order))
    ok = (F.coalesce("prev", F.lit(0)) == F.col("start")) & (F.col("end") > F.col("start"))
    return joined.groupBy(key).agg((F.bool_and(ok) & (F.max("end") == F.max("length"))).alias("tiled"))


def uncovered(ranges: DataFrame, key: str) -> DataFrame:
    """key, start, end of what the ranges leave open in 0 to ``length``."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ranges.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0))).filter("start > reach").select(key, F.col("reach").alias("start"), F.col("start").alias("end"))
    tail = ranges.groupBy(key).agg(F.max("end").alias("start"), F.max("length").alias("end")).filter("start < end")
    return gaps.unionByName(tail.select(key, "start", "end"))


def overlapping(ranges: DataFrame, key: str) -> DataFrame:
    """The ranges that begin before an earlier one of their key ends."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reach", F.max("end").over(before)).filter("start < reach").drop("reach")


def numbered(rows: DataFrame, keys: list[str], order: list, out: str = "place") -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... in ``order`` within the rows of equal ``keys``, whatever share of all rows a key has.

    Rows are sorted over range partitions, a hot key over many; each partition numbers its own, shifted by what its key has in the
    partitions before.  No window ever spans a key.  ``order`` must be total.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "numbered")
    keyed = rows.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    sort = [*keys, *[f"_o{i}" for i in range(len(order))]]
    parts = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).withColumn("_part", F.spark_partition_id())
    parts = scratch.keep(parts, "parts")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    counts = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition and key
    starts = counts.withColumn("_shift", shift).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_of"), "_shift")
    here = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*sort[len(keys) :]))
    joined = parts.withColumn("_here", here).join(starts, reduce(lambda a, b: a & b, [*same, F.col("_part") == F.col("_of")]))
    return joined.select(*rows.columns, (F.col("_here") + F.col("_shift")).alias(out))


def packets(chain: DataFrame, key: str, order: list, size: int) -> DataFrame:
    """key, packet, start, end, first_id, last_id, previous_id, next_id: an ordered chain in packets of ``size``."""
    place = numbered(chain.select(key, "event_id", *[c.alias(f"c{i}") for i, c in enumerate(order)]), [key], [F.col(f"c{i}") for i in range(len(order))], "nth").withColumn("at", F.col("nth") - 1)
    grouped = place.groupBy(key, F.floor(F.col("at") / size).cast("bigint").alias("packet")).agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.min_by("event_id", "at").alias("first_id"), F.max_by("event_id", "at").alias("last_id"))
    grouped = Scratch(chain.sparkSession, "packets").keep(grouped, "packets")
    before = grouped.select(key, (F.col("packet") + 1).alias("packet"), F.col("last_id").alias("previous_id"))
    after = grouped.select(key, (F.col("packet") - 1).alias("packet"), F.col("first_id").alias("next_id"))
    return grouped.join(before, [key, "packet"], "left").join(after, [key, "packet"], "left")
