"""Running computations over ordered groups that may be of any size.

A window puts a whole group into one task. Here the rows of groups above ``max_rows`` are first range-partitioned by group and order, so
that a large group spreads over many consecutive pieces; the window then runs inside (group, piece), and what earlier pieces hand to a
later one is a row per piece. Pieces are stored with their number, which therefore survives a lost executor. At most
``MOST_LARGE_GROUPS`` groups are large (the limit rises with the data to keep that true) and a piece holds about as many rows as the
limit, so the handed-over table has a few hundred thousand rows at most, whatever the size of the data: small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.tables import keep

MAX_ROWS = 2_000_000
MOST_LARGE_GROUPS = 100_000
PIECE = "_piece"


class Ordered:
    """``df`` grouped by ``keys`` and totally ordered inside a group by ``order``."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS):
        self.keys, self.order = list(keys), list(order)
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
        limit = max(max_rows, (total or 0) // MOST_LARGE_GROUPS)
        self.split = (largest or 0) > limit
        self.df, self.part = df, self.keys
        if self.split:
            self.large = keep(counts.filter(F.col("_n") > limit))
            rows = self.large.agg(F.sum("_n")).first()[0]
            names = F.broadcast(self.large.select(*self.keys))
            spread = df.join(names, self.keys, "left_semi").repartitionByRange(2 * (rows // limit) + 1, *self.keys, *self.order)
            spread = keep(spread.withColumn(PIECE, F.spark_partition_id()))
            self.df = df.join(names, self.keys, "left_anti").withColumn(PIECE, F.lit(0)).unionByName(spread)
            self.part = [*self.keys, PIECE]

    def _window(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def _hand_over(self, df: DataFrame, value: Column, carry) -> DataFrame:
        """Join ``_carry``: per piece, what ``carry`` makes of ``value`` over the earlier pieces of its group."""
        ahead = Window.partitionBy(*self.keys).orderBy(PIECE)
        per_piece = df.groupBy(*self.part).agg(value.alias("_value"))
        per_piece = per_piece.join(F.broadcast(self.large.select(*self.keys)), self.keys, "left_semi")
        return df.join(F.broadcast(per_piece.select(*self.part, carry(F.col("_value"), ahead).alias("_carry"))), self.part, "left")

    def row_number(self, name: str = "idx") -> DataFrame:
        """1-based position of every row in its group."""
        df = self.df.withColumn(name, F.row_number().over(self._window()).cast("bigint"))
        if self.split:
            df = self._hand_over(df, F.count(F.lit(1)), lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            df = df.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry", PIECE)
        return df

    def running_sum(self, column: str, name: str) -> DataFrame:
        """Sum of ``column`` over the rows of the group up to and including the row."""
        df = self.df.withColumn(name, F.sum(column).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        if self.split:
            df = self._hand_over(df, F.sum(column), lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            df = df.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry", PIECE)
        return df

    def previous(self, column: str, name: str) -> DataFrame:
        """Value of ``column`` (never null) in the row before."""
        df = self.df.withColumn(name, F.lag(column).over(self._window()))
        if self.split:
            df = self._hand_over(df, F.max_by(F.col(column), F.struct(*self.order)), lambda v, w: F.lag(v).over(w))
            df = df.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", PIECE)
        return df

    def last_known(self, value: Column, name: str, inclusive: bool) -> DataFrame:
        """Last non-null ``value`` before the row, or up to and including it."""
        end = 0 if inclusive else -1
        df = self.df.withColumn("_v", value)
        df = df.withColumn(name, F.last("_v", True).over(self._window().rowsBetween(Window.unboundedPreceding, end)))
        if self.split:
            latest = F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*self.order)))
            df = self._hand_over(df, latest, lambda v, w: F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            df = df.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", PIECE)
        return df.drop("_v")
