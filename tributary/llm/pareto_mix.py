"""Mixing sources to target weights by Pareto order sampling.

A source's target decides how often its documents are taken: ``floor(target / size)`` certain copies of each, and a sample for the rest.
The sample ranks documents by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and takes them in that order until the
words reach what the target leaves. Inclusion ``p`` is unequal: proportional to an importance class (the number of binary digits of the
document's size), scaled per source so that the expected words are the rest, capped at 1. ``u`` is a hash of the document's id, so runs
agree, on any partitioning.

No source is ever sorted in one task: ranks are cut into ``CELLS`` x ``CELLS`` cells, their words are summed before any shuffle, and
only the documents of the one cell in which the rest runs out are ordered. The tables per source, per (source, class) and per
(source, cell) do not grow with a source's documents.

Defined results: null text has size 0; such documents take nothing. Rows with equal id are sampled on their own and, being equal in rank,
fall in order of size (equal in size too: taken or left together); a null id is an id of its own. A null source is a source, last in order. An empty table gives an empty result.
Extra columns are not carried: the result is keyed by the id, columns named like results are replaced. Texts may be of any
length: only their number of words counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.tables import keep

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
CELLS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that make ``u``: 52 bits, the precision of a double.
DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("bigint")


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from a hash of ``key``."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sources in order of code points, null last, weigh ``weights`` in turn.

    A source whose share exceeds ``most`` times its size stops there and the excess is shared again by weight. The sources that stop are
    the first ones by size over weight, so one pass over the table of sources finds them all.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    total = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn))
    by_room = Window.orderBy((most * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    total = total.withColumn("rate", left / weight_left).withColumn("stops", F.col("rate") * F.col("w") > most * F.col("source_size"))
    # the rate of the first source that does not stop holds for all behind it
    total = total.withColumn("rate", F.min(F.when(~F.col("stops"), F.struct(most * F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("rate").alias("rate")))).over(everything)["rate"])
    target = F.when(F.col("stops"), most * F.col("source_size")).otherwise(F.col("rate") * F.col("w"))
    return total.select("source", "source_size", target.cast("double").alias("target"))


def _inclusion_rate(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, rate): p = min(1, rate * class) spends ``rest`` words of a source in expectation. Classes are few, so are the rows."""
    classes = sizes.filter("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    classes = classes.join(targets.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
    above = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(0, Window.unboundedFollowing)
    certain = F.coalesce(F.sum("words").over(above), F.lit(0))
    classes = classes.withColumn("rate", F.greatest(F.col("rest") - certain, F.lit(0.0)) / F.sum(F.col("words") * F.col("class")).over(below))
    # capping starts at the largest class; the first class that stays under 1 fixes the rate
    fits = F.when(F.col("rate") * F.col("class") <= 1, F.struct(-F.col("class"), F.col("rate").alias("rate")))
    return classes.groupBy(F.col("source").alias("_s")).agg(F.coalesce(F.min(fits)["rate"], F.lit(1.0)).alias("rate"))


def _runs_out(cells: DataFrame, cell: str) -> DataFrame:
    """(source, ``cell``, rest): the cell in which the words reach the rest, and what of the rest is left on entering it."""
    order = Window.partitionBy("source").orderBy(cell)
    passed = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("rest", F.col("rest") - passed)
    return cells.filter((F.col("rest") > 0) & (F.col("words") >= F.col("rest"))).select(F.col("source").alias("_s"), F.col(cell).alias(f"_{cell}"), F.col("rest").alias("_rest"))


def draw(sizes: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """What decides over every row of the stored table (key, source, size): a row per source, and the documents of the last cells."""
    sizes = sizes.withColumn("class", F.length(F.bin("size")))
    targets = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("bigint"))
    targets = keep(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    rates = _inclusion_rate(sizes, targets)
    targets = targets.join(rates, targets.source.eqNullSafe(rates._s), "left").drop("_s")
    targets = keep(targets.withColumnRenamed("source", "_s"))
    ranked = keep(_ranked(sizes, targets, key).filter("rank IS NOT NULL").select(key, "source", "size", "rest", "rank", "coarse", "fine"))
    sums = lambda df, cell: df.groupBy("source", cell).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    coarse = _runs_out(sums(ranked, "coarse"), "coarse")
    inside = ranked.join(coarse, F.col("source").eqNullSafe(F.col("_s")) & (F.col("coarse") == F.col("_coarse")))
    inside = keep(inside.withColumn("rest", F.col("_rest")).drop("_s", "_coarse", "_rest"))
    cell = keep(_runs_out(sums(inside, "fine"), "fine"))
    # in the last cell documents follow one by one; the one that crosses the rest is taken if that comes nearer
    last = inside.join(cell, F.col("source").eqNullSafe(F.col("_s")) & (F.col("fine") == F.col("_fine")))
    last = last.groupBy(key, "source", "size", "rank", "_rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("rank", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.coalesce(F.sum("words").over(order), F.lit(0))
    last = last.select(F.col(key).alias("_key"), F.col("source").alias("_s"), F.col("size").alias("_size"), ((left > 0) & (2 * left >= F.col("words"))).alias("_last"))
    per_source = targets.join(cell.select(F.col("_s").alias("_c"), "_fine"), F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c")
    return keep(per_source), keep(last)


def _ranked(rows: DataFrame, per_source: DataFrame, key: str) -> DataFrame:
    """Rows with what their source decides, their rank and its cells."""
    p = F.least(F.lit(1.0), F.col("rate") * F.length(F.bin("size")))
    u = uniform(F.col(key))
    # rank / (1 + rank) keeps the order and lies in [0, 1): certain ones come first
    odds = (u / (1 - u)) * ((1 - p) / p)
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("rank", F.when((F.col("size") > 0) & (p > 0), odds / (1 + odds)))
    rows = rows.withColumn("fine", F.least(F.floor(F.col("rank") * CELLS * CELLS), F.lit(CELLS * CELLS - 1)).cast("int"))
    return rows.withColumn("coarse", F.shiftright("fine", CELLS.bit_length() - 1))


def apply_draw(rows: DataFrame, drawn: tuple[DataFrame, DataFrame], key: str = "doc_id") -> DataFrame:
    """``rows`` (key, source, size and others) with source_size, target, copies and taken. Rows stay where they are if the two tables
    are small enough for Spark to broadcast, as they are unless there are very many sources."""
    per_source, last = drawn
    ranked = _ranked(rows.drop("source_size", "target", "copies", "taken"), per_source, key)
    in_last = F.col(key).eqNullSafe(F.col("_key")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size"))
    ranked = ranked.join(last, in_last, "left")
    extra = F.col("rank").isNotNull() & (F.col("rest") > 0) & ((F.col("fine") < F.col("_fine")) | F.col("_last"))
    ranked = ranked.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("bigint"))
    ranked = ranked.withColumn("taken", F.col("copies") * F.col("size"))
    return ranked.drop("whole", "rest", "rate", "rank", "fine", "coarse", "_fine", "_key", "_s", "_size", "_last")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) of every row of ``docs``."""
    sizes = keep(sized(docs, key, text, source))
    return apply_draw(sizes, draw(sizes, key, weights, share, most), key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; the columns of ``docs``."""
    drawn = draw(keep(sized(docs)))
    rows = apply_draw(docs.withColumn("size", word_count(F.col("text"))), drawn)
    return rows.filter("copies > 0").select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")


#: The same draw in DuckDB, document by document instead of by cells.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM s),
r AS (SELECT *, ({SHARE} * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
      FROM w WINDOW b AS (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CAST(CASE WHEN rate * w > {MOST} * source_size THEN {MOST} * source_size
        ELSE w * (SELECT arg_min(rate, {MOST} * source_size / w) FROM r WHERE rate * w <= {MOST} * source_size) END AS DOUBLE) AS target FROM r),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
t3 AS (SELECT *, target - whole * source_size AS rest FROM t2),
c AS (SELECT d.source, length(bin(size)) AS class, sum(size) AS words, any_value(rest) AS rest FROM d JOIN t3 ON d.source IS NOT DISTINCT FROM t3.source WHERE size > 0 GROUP BY 1, 2),
c2 AS (SELECT *, greatest(rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
        / sum(words * class) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c),
p AS (SELECT source, coalesce(arg_max(rate, class) FILTER (rate * class <= 1), 1.0) AS rate FROM c2 GROUP BY source),
q AS (SELECT d.*, t3.source_size, t3.target, t3.whole, t3.rest, least(1.0, p.rate * length(bin(d.size))) AS p,
        (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {DIGITS})) AS BIGINT) + 0.5) / {float(16**DIGITS)} AS u
      FROM d JOIN t3 ON d.source IS NOT DISTINCT FROM t3.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, CASE WHEN size > 0 AND p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM q),
o AS (SELECT *, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN odds IS NOT NULL AND room > 0 AND 2 * room >= size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o
"""
