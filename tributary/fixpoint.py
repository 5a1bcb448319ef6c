"""The iteration core: everything that follows edges until nothing new appears.

A graph is a DataFrame ``edges(func_id, src, dst)``: ``func_id`` names the graph a row belongs to, so one job serves millions of
small graphs and a few giant ones alike. All joins are on (func_id, node), never on func_id alone, hence one giant graph spreads over
all tasks; a hub node is left to the skew-join splitting of adaptive execution, which the plain equi joins here allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tributary.tables import Rounds, cut, drop, keep, real_sizes, settled, stored

GROUP = "func_id"


#: Up to ``FEW`` rows found, a job makes six hops, up to ``SMALL`` three: then jobs cost more than rows. More rows make one, or three where they are dealt out.
FEW, SMALL = 2_000, 200_000
#: Tables above so many rows are dealt out by graph, if no graph has more edges than this: they are stored in buckets by graph, and what is joined
#: with them on (graph, node) and stored likewise needs no shuffle, however many rounds there are.
DEAL, GRAPH = 50_000, 10_000
#: Rows of a bucket.
BUCKET = 500_000


def hops(n: int, dealt: int = 0) -> int:
    if n <= min(FEW, SMALL):
        return 6
    return 3 if n <= SMALL or dealt else 1


def buckets(spark, rows: int = 0) -> int:
    """Buckets of what is dealt out by graph: as many as a shuffle of the session has partitions, or more where these would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET)


def small_graphs(table: DataFrame, n: int) -> bool:
    """Whether a stored table of ``n`` rows is worth dealing out by graph, and none is too large for that."""
    return n > DEAL and largest(table) <= GRAPH


def largest(table: DataFrame) -> int:
    """The rows of the largest graph."""
    return table.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows`` (func_id, …) stored in buckets by graph where that is worth it and no graph has too many; else as they are."""
    if not hasattr(rows, "_dealt"):
        n = rows.count()
        rows = settled(rows, buckets(rows.sparkSession, n) if small_graphs(rows, n) else 0)
        rows._dealt = getattr(rows, "_dealt", 0)
    return rows


def edge_table(edges: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """At most one edge per (graph, source, sink), stored once for all rounds; dealt out as ``like`` if that is, else where it is worth it."""
    if getattr(edges, "_edge_table", False):
        return edges
    real_sizes(edges.sparkSession)
    dealt = getattr(like, "_dealt", 0)
    out, n, _ = cut(edges.select(GROUP, "src", "dst").distinct(), dealt=dealt)
    if not dealt and small_graphs(out, n):
        dealt = buckets(edges.sparkSession, n)
        last, out = out, keep(out, dealt)
        drop(last)
    out._edge_table, out._small_graphs, out._dealt = True, bool(dealt), dealt
    return out


def with_stays(edges: DataFrame) -> DataFrame:
    """Edges plus one from every sink to itself: rows can wait while others move on, and several hops fit into one job."""
    stays = edges.select(GROUP, F.col("dst").alias("src"), "dst").distinct()
    return keep(edges.filter("src <> dst").unionByName(stays), getattr(edges, "_dealt", 0))


def propagate(
    seed: DataFrame,
    edges: DataFrame,
    tags: Sequence[str] = (),
    stop: DataFrame | None = None,
    never: DataFrame | None = None,
    within: DataFrame | None = None,
    depth: str | None = None,
) -> DataFrame:
    """All (func_id, node, *tags) that follow from ``seed`` along ``edges``, each once.

    Rows matching ``stop`` (func_id, node and any of the tags) are kept but passed on no further; rows matching ``never`` are not
    taken up; where ``within`` is given, only rows matching it are. ``depth`` names an output column with the number of edges on a
    shortest way. Semi-naive: a round starts from what the last round found, and drops what is known. While little is found a job makes
    several hops, since then jobs cost more than rows.
    """
    key = [GROUP, "node", *tags]
    value = depth or "_depth"
    edges = edge_table(edges)
    edges_and_stays: DataFrame | None = None
    dealt = edges._dealt
    stop, never, within = (settled(df, dealt) for df in (stop if stop is None else stop.distinct(), never, within))

    def allowed(df: DataFrame) -> DataFrame:
        if never is not None:
            df = df.join(never, never.columns, "left_anti")
        if within is not None:
            df = df.join(within, within.columns, "left_semi")
        return df

    def hop(rows: DataFrame, along: DataFrame) -> DataFrame:
        if stop is not None:
            rows = rows.join(stop.withColumn("_stop", F.lit(True)), stop.columns, "left")
        rows = rows.withColumnRenamed("node", "src").join(along, [GROUP, "src"])
        if stop is not None:
            rows = rows.filter("_stop IS NULL OR src = dst")
        far = F.col(value) + F.when(F.col("src") == F.col("dst"), 0).otherwise(1)
        rows = rows.select(GROUP, F.col("dst").alias("node"), *tags, far.alias(value))
        return allowed(rows.groupBy(*key).agg(F.min(value).alias(value)))

    rounds = Rounds(dealt)
    frontier, n = rounds.add(allowed(seed.select(*key).distinct()).withColumn(value, F.lit(0)))
    while n:
        known = rounds.all().select(*key)
        found = hop(frontier, edges)
        for _ in range(hops(n, dealt) - 1):
            edges_and_stays = edges_and_stays or with_stays(edges)
            found = hop(found, edges_and_stays)
        # what was known before has been followed before, so it is enough to drop it once a job
        frontier, n = rounds.add(found.join(known, key, "left_anti"))
    out = rounds.all()
    if depth:
        return out
    out = out.drop(value)
    out._dealt = dealt
    return out


LOGS = 16


def least(edges: DataFrame, start: DataFrame, largest: bool = False) -> DataFrame:
    """(func_id, node, label): the smallest (or largest) label that reaches a node, its own included; ``start(func_id, node, label)``.

    The state is a log: a round appends the nodes whose label fell and goes on from them; the smallest entry of a node counts. Now and then
    the log is written anew.
    """
    key = [GROUP, "node"]
    edges = edge_table(edges)
    stays: DataFrame | None = None
    best = (F.max if largest else F.min)("label").alias("label")
    better = "old IS NULL OR label > old" if largest else "old IS NULL OR label < old"

    def step(rows: DataFrame, along: DataFrame) -> DataFrame:
        moved = rows.withColumnRenamed("node", "src").join(along, [GROUP, "src"])
        return moved.groupBy(GROUP, F.col("dst").alias("node")).agg(best)

    dealt = edges._dealt
    rounds = Rounds(dealt)
    changed, n = rounds.add(start.groupBy(*key).agg(best))
    while n:
        now = rounds.all().groupBy(*key).agg(best).withColumnRenamed("label", "old")
        found = step(changed, edges)
        for _ in range(hops(n, dealt) - 1):
            stays = stays or with_stays(edges)
            found = step(found, stays)
        found = found.join(now, key, "left").filter(better).drop("old")
        changed, n = rounds.add(found)
        if n and rounds.n > LOGS:
            last, rounds = rounds, Rounds(dealt)
            rounds.add(last.all().groupBy(*key).agg(best))
    out = keep(rounds.all().groupBy(*key).agg(best), dealt) if dealt else rounds.all().groupBy(*key).agg(best)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(func_id, src, dst) for every path of at least one edge, by doubling: rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    key = [GROUP, "src", "dst"]
    fresh, n, path = cut(edges.select(*key).distinct())
    paths = [path]
    while n:
        known = stored(spark, fresh.schema, paths)
        second = known.select(GROUP, F.col("src").alias("mid"), F.col("dst"))
        first = known.select(GROUP, "src", F.col("dst").alias("mid"))
        # one half of every new composition is new: fresh after known, and known after fresh
        left = fresh.select(GROUP, "src", F.col("dst").alias("mid")).join(second, [GROUP, "mid"]).select(*key)
        right = first.join(fresh.select(GROUP, F.col("src").alias("mid"), "dst"), [GROUP, "mid"]).select(*key)
        found = left.unionByName(right).distinct().join(known, key, "left_anti")
        fresh, n, path = cut(found)
        paths.append(path)
    return stored(spark, fresh.schema, paths)


def jump(parents: DataFrame, dealt: int = 0) -> DataFrame:
    """(func_id, node, parent, steps): the last parent of every node and the way to it. Pointer jumping, logarithmic rounds.

    ``parents(func_id, node, parent)`` holds each node once; a parent that is no node, or its own, ends the walk. A cycle ends at its smallest
    node, for the nodes on it as for those behind it. ``dealt``: the buckets to store the rounds in, where graphs are small.
    """
    parents = parents.select(GROUP, "node", "parent")
    own = F.col("node").eqNullSafe(F.col("parent"))
    now, n, _ = cut(parents.withColumns({"steps": F.when(own, 0).otherwise(1), "own": own, "moved": ~own}), dealt=dealt)
    before = size = None
    length = 1  # every parent is so many steps away, or the last one
    while n:
        if n == before:  # without cycles ever fewer nodes move
            size = size or now.groupBy(GROUP).count().agg(F.max("count")).first()[0]
            if length >= size:
                break
        before, last = n, now
        now, n, _ = cut(_doubled(_doubled(now)), F.col("moved"), dealt)
        drop(last)
        length *= 4
    if not n:
        out = now.drop("moved", "own")
        out._path, out._name, out._dealt = now._path, getattr(now, "_name", None), dealt
        return out
    stuck = now.filter("moved").select(GROUP, "node")
    ring = keep(parents.join(now.filter("moved").select(GROUP, F.col("parent").alias("node")).distinct(), [GROUP, "node"], "left_semi"))
    low = ring.withColumn("low", F.least("node", "parent"))
    length = 1
    while length < size:
        ahead = low.select(GROUP, F.col("node").alias("parent"), F.col("parent").alias("far"), F.col("low").alias("there"))
        last, low = low, keep(low.join(ahead, [GROUP, "parent"]).select(GROUP, "node", F.col("far").alias("parent"), F.least("low", "there").alias("low")))
        drop(last)
        length *= 2
    ends = low.filter("node = low").select(GROUP, "node", F.lit(True).alias("ends"))
    opened = parents.join(stuck, [GROUP, "node"], "left_semi").join(ends, [GROUP, "node"], "left")
    opened = opened.select(GROUP, "node", F.when(F.col("ends"), F.col("node")).otherwise(F.col("parent")).alias("parent"))
    return now.filter("NOT moved").drop("moved", "own").unionByName(jump(opened, dealt))


def _doubled(now: DataFrame) -> DataFrame:
    """Every walk goes on by as many steps as it has made."""
    up = now.filter("NOT own").select(
        GROUP, F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("steps").alias("more")
    )
    return now.join(up, [GROUP, "parent"], "left").select(
        GROUP,
        "node",
        F.coalesce("grand", "parent").alias("parent"),
        (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        "own",
        F.col("grand").isNotNull().alias("moved"),
    )
