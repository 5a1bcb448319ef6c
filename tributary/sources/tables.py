"""Base tables and the program-shaped views that are derived from them.

The views read logs, link tables and orders as programs: a user's week is a function, an event is an instruction, the step from one
event to the next is a control-flow edge. ``plans/registry.py`` states the same views as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.fixpoint import edge_table
from tributary.functions.ordered import Ordered
from tributary.tables import keep, real_sizes

WEEK = 604_800


class Tables:
    """The tables of one directory; a view is set up once per instance and stored where several joins read it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        real_sizes(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def flow_instr(self) -> DataFrame:
        """Events as instructions: one row per event, numbered inside its function."""
        seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
        k = F.get_json_object("props", "$.k").cast("int")
        rows = self.events.select(
            (F.col("user_id") * 100 + F.floor(seconds / WEEK)).alias("func_id"), "ts", "event_id", "event_type", "value", k.alias("k")
        )
        kind = (
            F.when(F.col("k") % 10 <= 5, "assignment")
            .when(F.col("k") % 10 == 6, "call")
            .when(F.col("k") % 10 == 7, "branch")
            .when(F.col("k") % 10 == 8, "relation")
            .otherwise("return")
        )
        form = F.element_at(F.array(*map(F.lit, ("copy", "operation", "constant", "address"))), F.col("k") % 4 + 1)
        numbered = Ordered(rows, ["func_id"], ["ts", "event_id"]).row_number("idx")
        return keep(
            numbered.select(
                "func_id",
                F.concat("event_type", F.lit("#"), F.col("k") % 3).alias("block"),
                "idx",
                "event_id",
                "k",
                "value",
                kind.alias("kind"),
                form.alias("form"),
                F.concat(F.lit("v"), F.col("k") % 7).alias("def_var"),
                F.concat(F.lit("v"), F.col("event_id") % 7).alias("use_var"),
                (F.col("k") % 11 == 0).alias("aliased"),
                F.col("event_type").alias("type"),
                (F.col("k") % 7 + 1).alias("complexity"),
            )
        )

    @cached_property
    def flow_steps(self) -> DataFrame:
        """Every step from one event to the next, repeated steps included."""
        return Ordered(self.flow_instr, ["func_id"], ["idx"]).previous("block", "src").filter("src IS NOT NULL").select(
            "func_id", "src", F.col("block").alias("dst"), "idx", "k"
        )

    @cached_property
    def flow_edges(self) -> DataFrame:
        return edge_table(self.flow_steps)

    @cached_property
    def flow_roots(self) -> DataFrame:
        return self.flow_instr.filter("idx = 1").select("func_id", F.col("block").alias("root"))

    @cached_property
    def flow_blocks(self) -> DataFrame:
        return keep(self.flow_instr.groupBy("func_id", "block").agg(F.count(F.lit(1)).alias("n_rows"), F.max("idx").alias("last_idx")))

    @cached_property
    def ssa_defs(self) -> DataFrame:
        """Every definition under a name of its own: name#idx."""
        return self.flow_instr.select(
            "func_id", "block", "idx", "kind", "form", "aliased", "type", "complexity", "k",
            F.col("def_var").alias("name"), F.concat_ws("#", "def_var", "idx").alias("var"),
        )

    @cached_property
    def ssa_uses(self) -> DataFrame:
        """Every use under the name of the last definition before it in the function; name#0 where there is none."""
        rows = self.flow_instr
        points = rows.select("func_id", "idx", F.col("use_var").alias("name"), F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("at"))
        known = rows.select("func_id", "idx", F.col("def_var").alias("name"), F.lit(1).alias("late"), F.col("idx").alias("at"))
        seen = Ordered(points.unionByName(known), ["func_id", "name"], ["idx", "late"]).last_known(F.col("at"), "ver", False)
        uses = seen.filter("late = 0").select("func_id", "idx", "name", F.coalesce("ver", F.lit(0)).alias("ver"))
        return keep(uses.withColumn("var", F.concat_ws("#", "name", "ver")).join(rows.select("func_id", "idx", "block"), ["func_id", "idx"]))

    @cached_property
    def ssa_copies(self) -> DataFrame:
        """dst = src for every copy row, in single-definition names."""
        copies = self.ssa_defs.filter("form = 'copy'").select("func_id", "idx", F.col("var").alias("dst"))
        return keep(copies.join(self.ssa_uses.select("func_id", "idx", F.col("var").alias("src")), ["func_id", "idx"]))

    @cached_property
    def phi_args(self) -> DataFrame:
        """A merge row per block with several predecessors and variable defined in at least two of them; one argument per predecessor."""
        defined = self.flow_instr.select("func_id", F.col("block").alias("src"), F.col("def_var").alias("name")).distinct()
        args = self.flow_edges.filter("src <> dst").join(defined, ["func_id", "src"])
        several = args.groupBy("func_id", "dst", "name").count().filter("count > 1").drop("count")
        return keep(
            args.join(several, ["func_id", "dst", "name"]).select(
                "func_id", F.col("dst").alias("block"), F.concat_ws("@", "name", "dst").alias("var"), F.col("src").alias("pred_block"),
                F.concat_ws("@", "name", "src").alias("arg"), "name",
            )
        )

    @cached_property
    def page_links(self) -> DataFrame:
        href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
        return self.pages.select(F.lit(0).cast("bigint").alias("func_id"), F.concat(F.lit("page:"), "page_id").alias("src"), href.alias("dst"))

    @cached_property
    def hier_edges(self) -> DataFrame:
        """region -> nation -> customer -> order."""

        def edges(df, parent, parent_key, child, child_key):
            return df.select(
                F.lit(0).cast("bigint").alias("func_id"),
                F.concat(F.lit(parent + ":"), parent_key).alias("src"),
                F.concat(F.lit(child + ":"), child_key).alias("dst"),
            )

        return (
            edges(self.nation, "r", "n_regionkey", "n", "n_nationkey")
            .unionByName(edges(self.customer, "n", "c_nationkey", "c", "c_custkey"))
            .unionByName(edges(self.orders, "c", "o_custkey", "o", "o_orderkey"))
        )

    @cached_property
    def line_rows(self) -> DataFrame:
        """Order lines numbered inside their order; an order's own line numbers repeat."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
        return Ordered(self.lineitem, ["l_orderkey"], order).row_number("idx")

    @cached_property
    def doc_lines(self) -> DataFrame:
        """Documents and the lines they hold, as a two-sided graph."""
        line = F.explode(F.array_distinct(F.split("text", "\n")))
        return self.documents.select("doc_id", line.alias("line")).filter("line <> ''").select(
            F.lit(0).cast("bigint").alias("func_id"), F.concat(F.lit("d"), "doc_id").alias("src"), F.concat(F.lit("l"), F.md5("line")).alias("dst")
        )
