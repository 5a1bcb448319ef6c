"""Divergence of sources from each other and from their language, by a frequent-pattern tree of term rows.

Kept are the terms that occur in at least ``LEAST`` documents of a language. A group (language, source) gives each kept term the share
``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))``, where ``N`` counts its kept occurrences and ``V`` the kept terms. Two sources differ by the sum of
``abs(p - q)`` over all kept terms, of which most are missing from most sources.

So the sum starts from ``V * abs(p0 - q0)``, as if both sources lacked every term, and is corrected. A term is a row of (source, share) for the sources
that have it, sources in one order (fewest occurrences first, so that rows begin with small counts, which repeat). Rows are inserted into a prefix
tree: a node is a prefix of rows, its multiplicity the number of terms below. A node corrects its source against all that may lack
the term (summed over the tree per source and share), and node and ancestor correct the pair of their sources, once for all terms below the node.

Counting needs one pass over the texts: a task adds up counts per (group, term), hands them over when it holds ``HELD`` of them, and
Spark adds these up in turn. Tables after that are as large as vocabularies; a path is at most as long as a language has sources. All numbers
are whole; shares of counts beyond 64-bit products are divided as 38-digit decimals.

Defined results: null text, language and source are empty strings. A text without terms counts only for its group, and every group and language that occurs is audited; without
kept terms its pairs have value 0. Texts may be of any length. Repeated rows are documents of their own. Ties in rank fall by the bytes of the item. Empty tables give an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tributary.llm.raw_texts import parts
from tributary.tables import keep

LEAST, TOP = 30, 50
SMOOTH, UNIT = 5, 1_000_000_000
#: Counts that a task holds at a time.
HELD = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, and an empty term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(lambda: (Counter(), Counter()))

        def handed() -> pa.RecordBatch:
            columns: list[list[pa.Array]] = [[], [], [], [], []]
            for (group_lang, group_source), (counts, among) in found.items():
                made = (
                    pa.repeat(pa.scalar(group_lang, pa.string()), len(counts)),
                    pa.repeat(pa.scalar(group_source, pa.string()), len(counts)),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                    pa.array([among[term] for term in counts], pa.int64()),
                )
                for column, part in zip(columns, made):
                    column.append(part)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            at, langs, sources = 0, batch.column(0), batch.column(1)
            for texts in parts(batch.column(2)):
                for i, raw in enumerate(texts, at):
                    counts, among = found[langs[i].as_py(), sources[i].as_py()]
                    before, words = len(counts), raw.translate(_TERMS).split()
                    counts[b""] += 0
                    counts.update(words)
                    among.update(set(words))
                    size += len(counts) - before
                at += len(texts)
                if size >= held:
                    yield handed()
                    size = 0
        if found:
            yield handed()

    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = given.mapInArrow(run, _COUNTS)
    # all of a term in one place, however many tasks and sources have it: a row per task and group at most
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, size: Column) -> Column:
    """``1 + floor(10**9 * (count + 5) / size)``, exact for any count; at most 10**9 + 1 for a count up to ``size``."""
    wide = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    exact = F.call_function("div", wide, size.cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < 2**33 - SMOOTH, F.call_function("div", (count + SMOOTH) * F.lit(UNIT).cast("bigint"), size)).otherwise(exact)


#: A path's item is ``rank * 2**SHARE_BITS + share``; shares stay below that.
SHARE_BITS = 30


class Audit:
    """The tables of an audit, each derived from the stored counts."""

    def __init__(self, counts: DataFrame, least: int = LEAST):
        # a row per term, with what each source has of it; kept terms, and one row per language that names its groups
        sources = F.collect_list(F.struct("source", "n")).alias("sources")
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), sources)
        terms = keep(terms.filter((F.col("term") == "") | (F.col("docs") >= least)).drop("docs"))
        #: (lang, term, total, sources) of kept terms
        self.terms = terms.filter("term <> ''")
        langs = self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
        groups = terms.select("lang", F.explode("sources").alias("s"))
        groups = groups.groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
        groups = groups.join(langs, "lang", "left").na.fill(0, ["v", "lang_n"])
        order = Window.partitionBy("lang").orderBy("n", "source")
        #: (lang, source, v, size, lang_size, rank, p0): a row per group
        self.groups = keep(
            groups.select(
                "lang", "source", "v",
                (F.col("n") + SMOOTH * F.col("v")).alias("size"),
                (F.col("lang_n") + SMOOTH * F.col("v")).alias("lang_size"),
                F.row_number().over(order).cast("bigint").alias("rank"),
            ).withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("size"))).otherwise(0))
        )
        #: (lang, source, term, total, n, p, rank, lang_size) of kept terms where they occur
        held = self.terms.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", "s.source", "s.n")
        self.counts = held.join(self.groups.select("lang", "source", "size", "lang_size", "rank"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size")))

    def nodes(self) -> DataFrame:
        """(lang, path, m): the nodes of the tree with the number of terms below; a path holds the items from the root down."""
        item = F.shiftleft("rank", SHARE_BITS) + F.col("p")
        rows = self.counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(item)).alias("path"))
        rows = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m"))
        prefixes = rows.select("lang", "m", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("d"))
        return prefixes.groupBy("lang", F.slice("path", F.lit(1), F.col("d")).alias("path")).agg(F.sum("m").alias("m"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for every two sources of a language, both ways."""
        nodes = keep(self.nodes())
        end = F.element_at("path", -1)
        a = self.groups.select("lang", "rank", "p0")
        b = self.groups.select("lang", F.col("rank").alias("other"), F.col("p0").alias("q0"))
        p0, q0, p, q = map(F.col, ("p0", "q0", "p", "q"))
        low = F.lit((1 << SHARE_BITS) - 1)
        one = nodes.groupBy("lang", end.alias("item")).agg(F.sum("m").alias("m"))
        one = one.select("lang", F.shiftright("item", SHARE_BITS).alias("rank"), F.col("item").bitwiseAND(low).alias("p"), "m")
        one = one.join(a, ["lang", "rank"]).join(b, "lang").filter("rank <> other").withColumn("value", F.col("m") * (F.abs(p - q0) - F.abs(p0 - q0)))
        two = nodes.select("lang", "m", end.alias("lower"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("upper"))
        two = two.select(
            "lang", "m", F.shiftright("upper", SHARE_BITS).alias("rank"), F.col("upper").bitwiseAND(low).alias("p"),
            F.shiftright("lower", SHARE_BITS).alias("other"), F.col("lower").bitwiseAND(low).alias("q"),
        ).join(a, ["lang", "rank"]).join(b, ["lang", "other"])
        two = two.withColumn("value", F.col("m") * (F.abs(p - q) - F.abs(p - q0) - F.abs(p0 - q) + F.abs(p0 - q0)))

        def summed(rows: DataFrame) -> DataFrame:
            return rows.groupBy("lang", F.least("rank", "other").alias("rank"), F.greatest("rank", "other").alias("other")).agg(F.sum("value").alias("more"))

        corrections = summed(one).unionByName(summed(two)).groupBy("lang", "rank", "other").agg(F.sum("more").alias("more"))
        start = self.groups.select("lang", "rank", "v", "p0").join(b, "lang").filter("rank < other")
        start = start.select("lang", "rank", "other", (F.col("v") * F.abs(p0 - q0)).alias("value"))
        value = (F.col("value") + F.coalesce("more", F.lit(0))).cast("bigint").alias("value")
        found = start.join(corrections, ["lang", "rank", "other"], "left").select("lang", "rank", "other", value)
        names = self.groups.select("lang", "rank", "source")
        items = self.groups.select("lang", F.col("rank").alias("other"), F.col("source").alias("item"))
        found = keep(found.join(names, ["lang", "rank"]).join(items, ["lang", "other"]))
        return found.select("lang", "source", "item", "value").unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    def excesses(self) -> DataFrame:
        """(lang, source, item, value): terms that a source has more of than its language."""
        more = F.col("p") - share(F.col("total"), F.col("lang_size"))
        return self.counts.select("lang", "source", F.col("term").alias("item"), more.cast("bigint").alias("value")).filter("value > 0")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for all other sources, and the ``top`` ``term`` rows of every group."""
    audit = Audit(term_counts(docs), least)
    ahead = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(ahead))
    terms = audit.excesses().withColumn("rank", F.row_number().over(ahead)).filter(F.col("rank") <= top)
    columns = ["item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST}
), langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) USING (lang, source) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (g.n + {SMOOTH} * l.v) AS p,
    1 + ({UNIT}::HUGEINT * (k.total + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q
  FROM groups AS g JOIN kept AS k ON k.lang = g.lang JOIN langs AS l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense AS x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN dense AS y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""
