"""Joining points with intervals without comparing all of them.

An interval is cut into blocks of sizes 1, 2, 4, … aligned to their size, at most two per size; a point lies in one block of every
size. Point and interval meet in exactly one block, if at all, so an equi join on the block gives each pair once and produces nothing
that is not a result. Long and short intervals, dense and sparse keys cost the same per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """Join on ``keys`` and ``low <= at < high``; all three are whole numbers. Other columns must not share names."""
    longest = intervals.agg(F.max(F.col(high) - F.col(low))).first()[0] or 0
    top = max(int(longest).bit_length() - 1, 0)

    def blocks(level):
        # shifts round down, also below zero, and are exact over the whole range
        shift = lambda x: F.call_function("shiftright", x, level)
        first = shift(F.col(low).cast("bigint") - 1) + 1
        last = shift(F.col(high).cast("bigint"))
        left = F.when((first < last) & (first.bitwiseAND(F.lit(1)) == 1), first)
        right = F.when((first < last) & (last.bitwiseAND(F.lit(1)) == 1), last - 1)
        return F.array(F.struct(level.alias("level"), left.alias("block")), F.struct(level.alias("level"), right.alias("block")))

    sizes = F.array(*[F.lit(i) for i in range(top + 1)])
    cover = F.filter(F.flatten(F.transform(sizes, blocks)), lambda b: b.block.isNotNull())
    # the two ends of a size may be the same block
    covered = intervals.withColumn("_at", F.explode(F.array_distinct(cover)))
    spot = F.transform(sizes, lambda i: F.struct(i.alias("level"), F.call_function("shiftright", F.col(at).cast("bigint"), i).alias("block")))
    return points.withColumn("_at", F.explode(spot)).join(covered, [*keys, "_at"]).drop("_at")


def in_section(addresses: DataFrame, sections: DataFrame) -> DataFrame:
    """(sample_id, address, in_section, in_read_only): sections hold ``start <= address < end``, read-only ones also their end."""
    asked = addresses.select("sample_id", "address").distinct()
    read_only = F.col("semantics") == "read_only"
    spans = sections.select(
        "sample_id", "start", (F.col("end") + read_only.cast("int")).alias("stop"), "end", read_only.alias("read_only")
    )
    met = points_in_intervals(asked, spans, ["sample_id"], "address", "start", "stop")
    met = met.groupBy("sample_id", "address").agg(F.bool_or(F.col("address") < F.col("end")).alias("i"), F.bool_or("read_only").alias("r"))
    out = asked.join(met, ["sample_id", "address"], "left")
    return out.select("sample_id", "address", F.coalesce("i", F.lit(False)).alias("in_section"), F.coalesce("r", F.lit(False)).alias("in_read_only"))
