"""N-gram Jaccard join by signature trees.

A document's set is the hashes of its distinct five-word shingles; documents with equal sets are one class. Two classes link at
``|a & b| / |a | b| >= 3/4``. Links are found in three steps, none of which drops a pair that could link.

Roots. Tokens below a hash limit, which falls with the set's size, are *routes*. If ``b`` is not larger than ``a`` and both link, ``a`` lacks at
most ``|b| // 7`` tokens of ``b``; so of any ``|b| // 7 + 1`` routes of ``b`` that are routes of every such ``a``, one is shared. ``b`` asks
by the rarest of its routes. Ordinary texts have enough routes of their own and ask nobody; passages that many texts share are asked for
only by texts that consist of little else. Sets link to nothing and are left out if more than a quarter of their tokens are routes of every
set that may link, and nobody else has them.
Whoever asks, or is asked, does so again by all tokens, which leaves few questions; then the larger set, too, is found only by its rarest quarter.

Clusters. Every class first compares itself with one other, of those that share a frequent route the one whose routes are shared most;
linked classes grow together into clusters. Pairs inside a cluster need no further look: the result is components. Where a token that is asked for would
still bring together many clusters with many, every class that has it compares itself once more, with the best by bitmap of a few others of other clusters that are
drawn anew each time. This goes on while it joins clusters, in as many comparisons as there are members. So groups of thousands of near copies become few
clusters before any pairs of clusters are formed.

Tree. Clusters are the roots of signature trees, with levels of chunks of about ``FAN`` nodes below and classes as leaves. A node holds the OR of its
members' token bitmaps, the range of their sizes, the largest number of tokens of a member that others have (``most``) and the largest number
that a member's bitmap does not tell apart (``slack``). Root pairs come from the routes; dual traversal goes down pairs of nodes and drops a pair if the sizes exclude a link, or if the maximum
possible overlap, ``min(slack) + bits in common`` or the smaller ``most``, is below ``3/7`` of the smallest sizes together. What is left at the leaves is compared by
whole texts.

Should a set have too few routes (the limits leave a chance of about 1 to 10^9), the limits are doubled and the search repeated.

Defined results: null, empty and wordless texts have an empty set, link to nothing and are components of their own; every row is judged by its own
text, so rows with equal id or without one are in one component only if their texts are; a component is named by its smallest id, null if it has
none; an empty table gives an empty result; extra columns are ignored. Texts may be of any length; a set is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tributary.llm.known import tidy
from tributary.operators.graph import components
from tributary.tables import cut, drop, keep, release

WIDTH = 5
LONGS = 32
BITS = 64 * LONGS
#: Nodes below a node, and levels of chunks between roots and leaves.
FAN, HEIGHT, KINDS = 8, 2, 8
#: Part of the hash range that makes a route: LIMIT + LIMIT_SMALL / size.
LIMIT, LIMIT_SMALL = 0.34, 25.0
#: Clusters that a token may bring together without more ado, and the part of them that a further comparison may at most leave.
CROWD, ENOUGH = 8, 0.9
#: Ids that may be sent to every task; beyond it the documents are shuffled to them.
MOST_SENT = 1_000_000
NO_ID = np.iinfo(np.int64).max
#: Numbers that a task hands over at once.
MOST_HELD = 250_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for n places."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").translate(_LOWER), np.uint8)
    blank = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    powers, inverses = _upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    words = _mix((sums[end] - sums[start]) * inverses[start])
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * powers[k + 1]
    return np.unique(_mix(total))


def route_limit(n: int, widening: float) -> np.uint64:
    """Hashes up to this one are routes of sets of ``n`` tokens; it never rises with ``n``."""
    part = widening * (LIMIT + LIMIT_SMALL / max(1, n))
    return np.uint64(2**64 - 1 if part >= 1 else int(part * 2.0**64))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """LONGS 64-bit words with a bit per token."""
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens >> np.uint64(7)) % np.uint64(BITS)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


SETS = "rep bigint, doc_id bigint, h bigint, n bigint, d1 bigint, d2 bigint, inner int, routes array<bigint>, bits array<bigint>"


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, text): ids and texts without nulls, and a hash of the text; rows of equal doc_id and h are the same."""
    docs = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def token_sets(docs: DataFrame, widening: float = 1.0) -> DataFrame:
    """A row of SETS per row (rep, doc_id, h, text): size, digest, routes in order (the first ``inner`` are routes of all that may link), bitmap."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for rep, doc, h, value in zip(batch["rep"], batch["doc_id"], batch["h"], batch["text"]):
                s = shingles(value)
                n = len(s)
                own, far = route_limit(n, widening), route_limit(4 * n // 3, widening)
                routes = s[: np.searchsorted(s, own, "right")]
                digest = [int(_mix(s, seed).sum(dtype=np.uint64).astype(np.int64)) for seed in (1, 2)]
                rows.append((rep, doc, h, n, *digest, int(np.searchsorted(s, far, "right")), routes.view(np.int64), bitmap(s)))
                held += len(routes) + LONGS
                if held >= MOST_HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in SETS.split(", ")]
    return docs.select("rep", "doc_id", "h", "text").mapInPandas(run, SETS)


# pairs

#: For sizes x and y: no link is possible where one is below 3/4 of the other.
_fits = lambda x, y: (4 * x >= 3 * y) & (4 * y >= 3 * x)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def _rows(reps: DataFrame, names: DataFrame, docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows (rep, doc_id, h, text) of ``docs`` that stand for classes, as many as the input repeats them; the number of classes."""
    named, n, _ = cut(names.join(reps, "rep", "left_semi").select("rep", "doc_id", "h"))
    return docs.join(_sent(named, n), ["doc_id", "h"]).select("rep", "doc_id", "h", "text"), n


def verify(pairs: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored pairs (a, b) of classes whose texts link, compared by their whole sets."""
    found, n = _rows(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), names, docs)
    texts, rows, _ = cut(found.select("rep", "text"))
    if rows > n:
        texts = keep(texts.groupBy("rep").agg(F.min("text").alias("text")))
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")

    @tidy
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            known: tuple[str, np.ndarray] | None = None
            out = []
            for x, y in zip(left, right):
                if known is None or known[0] != y:
                    known = (y, shingles(y))
                a, b = shingles(x), known[1]
                both_ = len(np.intersect1d(a, b, assume_unique=True))
                out.append(bool(both_) and 100 * both_ >= 75 * (len(a) + len(b) - both_))
            yield pd.Series(out, dtype=bool)

    links = F.pandas_udf(run, "boolean", F.PandasUDFType.SCALAR_ITER)("x", "y")
    linked = keep(both.withColumn("_link", links).filter("_link").select("a", "b"))
    drop(texts)
    return linked


def _clusters(links: DataFrame) -> DataFrame:
    """(rep, root) of every class with a link."""
    edges = links.select(F.lit(0).alias("func_id"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return keep(components(edges).select(F.col("node").alias("rep"), F.col("component").alias("root")))


def _first_links(routes: DataFrame, classes: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of every class with the best of the classes that lead one of its routes."""
    known = classes.select("rep", "n", "inner", (F.col("shared") / F.col("total")).alias("part"))
    rows = routes.select("token", "rep").join(known.select("rep", "part"), "rep")
    lead = rows.groupBy("token").agg(F.max(F.struct("part", (-F.col("rep")).alias("rep")))["rep"].alias("lead"))
    rows = rows.join(lead.select("token", (-F.col("lead")).alias("lead")), "token").filter("rep <> lead")
    pairs = rows.groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("common"))
    sides = known.select("rep", "n", "inner")
    pairs = pairs.join(sides, "rep").join(sides.select(F.col("rep").alias("lead"), F.col("n").alias("m"), F.col("inner").alias("inner_m")), "lead")
    # of the smaller set's inner routes at most ``common`` are shared
    n, inner = F.least("n", "m"), F.when(F.col("n") <= F.col("m"), F.col("inner")).otherwise(F.col("inner_m"))
    possible = n - F.greatest(inner - F.col("common"), F.lit(0))
    pairs = pairs.filter(_fits(F.col("n"), F.col("m")) & (7 * possible >= 3 * (F.col("n") + F.col("m"))))
    best = pairs.groupBy("rep").agg(F.max(F.struct("common", (-F.col("lead")).alias("lead")))["lead"].alias("lead"))
    return verify(keep(best.select(F.least("rep", -F.col("lead")).alias("a"), F.greatest("rep", -F.col("lead")).alias("b")).distinct()), names, docs)


def _crowded(members: DataFrame, questions: DataFrame, clusters: DataFrame) -> DataFrame:
    """The stored rows (token, rep, root) of tokens by which many clusters would meet many."""
    named = lambda df: df.join(clusters, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    have = members.select("token", "rep", F.lit(0).alias("asks")).unionByName(questions.select("token", "rep", F.lit(1).alias("asks")))
    roots = named(have).groupBy("token", "root").agg(F.max("asks").alias("asks"))
    meet = roots.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("asks").alias("asks"))
    return keep(named(members.join(meet.filter((F.col("asks") > CROWD) & (F.col("n") > CROWD)).select("token"), "token", "left_semi")))


def _drawn_links(rows: DataFrame, classes: DataFrame, names: DataFrame, docs: DataFrame, turn: int) -> DataFrame:
    """Links of every class of ``rows(token, rep, root)`` with the best of the classes of other clusters that were drawn for its tokens, one or two each.

    The first turn draws the classes with the most common tokens: the others of a crowd are variants of these.
    """
    first = F.xxhash64("rep", F.lit(turn)) if turn else F.col("usual")
    rows = rows if turn else rows.join(classes.select("rep", "usual"), "rep")
    rows = rows.select("token", "rep", "root", F.struct(first.alias("first"), "rep", "root").alias("draw"))
    one = rows.groupBy("token").agg(F.max("draw").alias("one"))
    rows = keep(rows.join(one, "token"))
    two = rows.filter("root <> one.root").groupBy("token").agg(F.max("draw").alias("two"))
    drawn = rows.join(two, "token").select("rep", F.when(F.col("root") != F.col("one.root"), F.col("one.rep")).otherwise(F.col("two.rep")).alias("other")).distinct()
    sides = classes.select("rep", "n", "bits")
    pairs = drawn.join(sides, "rep").join(sides.select(F.col("rep").alias("other"), F.col("n").alias("m"), F.col("bits").alias("bits_m")), "other")
    common = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseAND(F.get("bits_m", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    likely = (common / (F.col("n") + F.col("m"))).alias("likely")
    best = pairs.filter(_fits(F.col("n"), F.col("m"))).groupBy("rep").agg(F.max(F.struct(likely, "other"))["other"].alias("other"))
    return verify(keep(best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()), names, docs)


def _joined_crowds(near: DataFrame, routes: DataFrame, questions: DataFrame, classes: DataFrame, names: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, clusters) after classes that share crowded tokens have found each other."""
    clusters, turn = _clusters(near), 0
    members = keep(routes.join(questions.select("token").distinct(), "token", "left_semi").select("token", "rep"))
    while True:
        rows = _crowded(members, questions, clusters)
        before = rows.select("root").distinct().count()
        if not before:
            return near, clusters
        near = keep(near.unionByName(_drawn_links(rows, classes, names, docs, turn)))
        clusters, turn = _clusters(near), turn + 1
        after = rows.select("rep").distinct().join(clusters, "rep", "left").select(F.coalesce("root", "rep")).distinct().count()
        if after > ENOUGH * before:
            return near, clusters


def _questions(routes: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, rep): the rarest inner routes of each class, one more than a linked class may lack, as far as others have them."""
    inner = routes.filter("is_inner")
    counted = inner.groupBy("rep").agg(F.count(F.lit(1)).alias("known"))
    # routes that no other class has come first, and need not be asked
    asks = F.floor(F.col("n") / 7) + 1 - (F.col("inner") - F.col("known"))
    few = classes.join(counted, "rep").select("rep", asks.alias("asks")).filter("asks > 0")
    order = Window.partitionBy("rep").orderBy("df", "token")
    ranked = inner.join(few, "rep").withColumn("_at", F.row_number().over(order))
    return ranked.filter("_at <= asks").select("token", "rep")


def _prefixes(routes: DataFrame) -> DataFrame:
    """(token, rep, n, limit, asks): of all tokens of a set the rarest ones, by which it is found, and the size that a set which links and shares none
    before this one may have at most.

    Sets of n tokens and m >= n that link share 3/7 of n + m tokens at least, which is 6/7 of n and 3/4 of m. In any one order of all tokens the first
    ``n - 6/7 n + 1`` of the one and the first ``m - 3/4 m + 1`` of the other then have one in common. From the first common token on, either set must have
    as many tokens as both share. Tokens of one set only come first in the order of rarity, and need no row.
    """
    at = F.row_number().over(Window.partitionBy("rep").orderBy("df", "token")) + F.col("n") - F.col("most")
    rows = routes.withColumn("_at", at).filter(F.col("_at") <= F.floor(F.col("n") / 4) + 1)
    limit = F.expr("(7 * (n - _at + 1) - 3 * n) div 3").alias("limit")
    return rows.select("token", "rep", "n", limit, (F.col("_at") <= F.floor(F.col("n") / 7) + 1).alias("asks"))


def _or(column: str = "bits") -> Column:
    return F.array(*[F.bit_or(F.get(column, F.lit(i))) for i in range(LONGS)]).alias(column)


def _ones(bits: str) -> Column:
    return sum((F.bit_count(F.get(bits, F.lit(i))) for i in range(LONGS)), F.lit(0))


def tree(classes: DataFrame, clusters: DataFrame) -> list[DataFrame]:
    """Stored levels, roots first: (node, up, lo, hi, most, slack, bits). A node's name is unique in its level, ``up`` names it above."""
    leaves = classes.join(clusters, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # members that lack as many tokens in all others stand together, in KINDS ranges from none to a quarter
    leaves = leaves.withColumn("kind", F.floor(4 * KINDS * (F.col("n") - F.col("most")) / (F.col("n") + 1)))
    sizes = leaves.groupBy("root", "kind").agg(F.count(F.lit(1)).alias("members"))
    leaves = leaves.join(sizes, ["root", "kind"])
    # chunks are numbered within their root and kind; FAN of them in a row are one of the next level
    place = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / FAN))
    root = F.col("root").cast("string")
    names = [F.concat_ws("/", "root", "kind", F.lit(height), F.floor(place / FAN ** (height - 1))) for height in range(1, HEIGHT + 1)] + [root]
    slack = (F.col("n") - _ones("bits")).alias("slack")
    above = [name.alias(f"up_{i}") for i, name in enumerate(names)]
    level = F.col("rep").cast("string").alias("node"), F.col("n").alias("lo"), F.col("n").alias("hi"), "most", slack, "bits", *above
    levels = [keep(leaves.select(*level))]
    for height in range(HEIGHT + 1):
        up = [F.first(f"up_{i}").alias(f"up_{i}") for i in range(height + 1, HEIGHT + 1)]
        merged = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("most").alias("most"), F.max("slack").alias("slack"), _or()]
        levels.append(keep(levels[-1].groupBy(F.col(f"up_{height}").alias("node")).agg(*merged, *up)))
    return [df.withColumn("up", F.col(f"up_{i}") if i <= HEIGHT else F.lit(None).cast("string")) for i, df in enumerate(levels)][::-1]


def _may_link(pairs: DataFrame, level: DataFrame, by: str) -> DataFrame:
    """Of the pairs of nodes that pairs (a, b) name ``by`` themselves or what is above them, those with possible links below them."""
    sides = []
    for s in ("a", "b"):
        columns = [F.col(c).alias(f"{c}_{s}") for c in ("node", "lo", "hi", "most", "slack", "bits")]
        sides.append(level.select(F.col(by).alias(s), *columns))
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    sizes = (4 * F.col("hi_a") >= 3 * F.col("lo_b")) & (4 * F.col("hi_b") >= 3 * F.col("lo_a"))
    common = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseAND(F.get("bits_b", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    possible = F.least(F.least("slack_a", "slack_b") + common, "most_a", "most_b")
    met = met.filter(sizes & (7 * possible >= 3 * (F.col("lo_a") + F.col("lo_b"))))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def traverse(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Dual traversal: pairs of leaves below pairs of roots that may link."""
    pairs = keep(_may_link(pairs, levels[0], "node"))
    for level in levels[1:]:
        last, pairs = pairs, keep(_may_link(pairs, level, "up"))
        drop(last)
    return pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


def _root_pairs(routes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b) of different clusters, a < b, one of which asks for a route that the other has."""
    named = lambda df: df.join(clusters, "rep", "left").withColumn("root", F.coalesce("root", "rep")).drop("rep")
    have = named(routes)
    asked = have.filter("asks").groupBy("token", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("limit").alias("far"))
    have = have.groupBy("token", "root").agg(F.min("n").alias("from"), F.max(F.least("n", "limit")).alias("to"))
    met = asked.join(have.withColumnRenamed("root", "other"), "token").filter("root <> other")
    # the one that asks is not the larger
    met = met.filter("to >= lo AND 3 * from <= 4 * hi AND from <= far").select(F.least("root", "other").alias("a"), F.greatest("root", "other").alias("b"))
    return met.distinct().select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


def shared_routes(sets: DataFrame) -> DataFrame:
    """(rep, n, is_inner, token, df) of sets (rep, n, inner, routes): the routes that several have. Others say nothing about pairs."""
    rows = sets.select("rep", "n", "inner", F.posexplode("routes").alias("at", "token"))
    df = F.count(F.lit(1)).over(Window.partitionBy("token"))
    return rows.select("rep", "n", (F.col("at") < F.col("inner")).alias("is_inner"), "token", df.alias("df")).filter("df > 1")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links) of ``hashed`` documents: sets per row; classes (n, d1, d2, rep, doc_id, h) with the key of one of their rows, its
    id, which is the smallest of the class, and its hash; enough links (a, b) between classes to connect every class with all that it links to."""
    widening = 1.0
    while True:
        # the key of a row is stored with its set, and is not made again
        sets, unlucky, _ = cut(token_sets(docs.withColumn("rep", F.monotonically_increasing_id()), widening), F.expr("n > 0 AND inner <= n div 7"))
        if not unlucky:
            break
        widening *= 2
    digest = ["n", "d1", "d2"]
    classes = sets.filter("n > 0").groupBy(*digest).agg(F.min(F.struct("doc_id", "h", "rep")).alias("_first"))
    classes = keep(classes.select(*digest, "_first.rep", "_first.doc_id", "_first.h"))
    whole, sets = sets, keep(sets.select("rep", "doc_id", "h", *digest))
    others = classes.select(*digest, F.col("rep").alias("_rep"), F.struct("doc_id", "h").alias("_name"))
    others = sets.filter("n > 0").select("rep", F.struct("doc_id", "h").alias("name"), *digest).join(others, digest).filter("rep <> _rep")
    copies, n, _ = cut(others.select("rep", (F.col("name") == F.col("_name")).alias("twin")))
    first = whole.filter("n > 0").join(_sent(copies.select("rep"), n), "rep", "left_anti")
    first = first.select("rep", "n", "inner", F.size("routes").alias("total"), "bits", "routes")
    routes = keep(shared_routes(first))
    shared = routes.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"), F.count_if("is_inner").alias("shared_inner"))
    # a set lacks at most a quarter of its tokens in one that it links to, and an inner route that nobody else has as a route is lacking
    # everywhere; of the other routes a larger set may have some without their being its routes
    known = keep(first.drop("routes").join(shared, "rep").filter("4 * (inner - shared_inner) <= n").drop("shared_inner"))
    last, routes = routes, keep(routes.join(known.select("rep"), "rep", "left_semi"))
    drop(whole, last)
    release(docs.sparkSession)
    near = _first_links(routes, known, classes, docs)
    # a sample of tokens lets many ask in vain: those who ask, and those who have what is asked for, do it again with all their tokens
    asked = _questions(routes, known).select("token").distinct()
    met, _ = _rows(routes.join(asked, "token", "left_semi").select("rep").distinct(), classes, docs)
    if copies.filter("twin").limit(1).count():
        met = met.groupBy("rep", "doc_id", "h").agg(F.min("text").alias("text"))
    last, routes = routes, keep(shared_routes(token_sets(met, float("inf")).select("rep", "n", "inner", "routes")))
    drop(last)
    shared = routes.groupBy("rep").agg(F.count(F.lit(1)).alias("most"), (F.sum("df") / F.first("n")).alias("usual"))
    last, known = known, keep(known.drop("shared").withColumn("inner", F.col("n").cast("int")).join(shared, "rep").filter("4 * most >= 3 * n"))
    drop(last)
    release(docs.sparkSession)
    last, routes = routes, keep(_prefixes(routes.join(known.select("rep", "most"), "rep")))
    drop(last)
    questions = keep(routes.filter("asks").select("token", "rep"))
    near, clusters = _joined_crowds(near, routes, questions, known, classes, docs)
    levels = tree(known, clusters)
    met = traverse(_root_pairs(routes, clusters), levels)
    drop(routes, questions, *levels)
    return sets, classes, near.unionByName(verify(met, classes, docs))


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, component) per row of ``hashed`` documents."""
    sets, classes, found = links(docs)
    clusters = _clusters(found)
    lowest = clusters.join(classes.select("rep", "doc_id"), "rep").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    named = classes.join(clusters.join(lowest, "root").select("rep", "lowest"), "rep", "left")
    named = named.select("n", "d1", "d2", F.coalesce("lowest", "doc_id").alias("component"))
    out = sets.select("doc_id", "h", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", "h", "n", F.coalesce("component", "doc_id").alias("component"))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``."""
    back = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    out = _components(hashed(docs, key, text))
    return out.select(back("doc_id").alias(key), F.col("n").alias("n_shingles"), back("component").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the rows with its smallest id. Texts without words and rows without an id stay."""
    found = _components(hashed(docs))
    gone, n, _ = cut(found.filter((F.col("doc_id") != F.lit(int(NO_ID))) & (F.col("doc_id") != F.col("component"))).select("doc_id", "h").distinct())
    # rows of one id with different texts may be in different components
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    same = (F.col("doc_id").cast("bigint") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    return docs.join(_sent(gone, n), same, "left_anti").select(*docs.columns)
