"""Decontamination: benchmark passages found in texts by one Aho-Corasick automaton.

Items (questions and answers) and texts are normalised alike: A-Z to lower case, everything but letters, digits and non-ASCII characters to blanks. A
*window* is any ``WINDOW`` consecutive words of an item, or all its words if it has fewer. The automaton holds every distinct window as
`` w1 w2 .. wk `` with a blank at both ends, so that only whole words match; a text is read once, and all windows that end at a place
come from the failure links. Matches are turned into word numbers, and these into offsets in the original text, by counting the blanks
of the normalised one; words of both are the same and in the same order.

Size: the pairs of window and item are stored and counted. They are dealt by hash into blocks of about ``BLOCK_CHARS`` characters, so an automaton
takes about 100 MB whatever the benchmark; only such a block is collected and broadcast. A benchmark of one block (some thousand items) takes one pass over the
texts. Every further block takes another one, whose spans and items are added to those found before; between two passes the table is stored.

Defined results: a null or empty text, or one without words, has no hits; an item without words has no window. Texts and items may be of any length. Repeated items
and windows shared by items count for every item id; equal ids are one item; a null item id is written as an empty string. Rows of
documents are independent of each other, so repeated rows and null ids are kept. Empty tables on either side give no hits. Extra columns are carried along; those named like results
are replaced.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections import defaultdict

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.llm.raw_texts import add_columns
from tributary.tables import keep

WINDOW = 10
BLOCK_CHARS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_NORMAL = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: Column) -> Column:
    """Normalised words of a text, as an array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, n, window): the distinct windows of every item, ``n`` words each, joined by blanks."""
    held = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("_words"))
    held = held.filter(F.size("_words") > 0).withColumn("n", F.least(F.size("_words"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("_words") - F.col("n") + 1)
    found = F.transform(starts, lambda i: F.array_join(F.slice("_words", i, F.col("n")), " "))
    return held.select("item", "n", F.explode_outer(found).alias("window")).distinct()


class Automaton:
    """The windows of one block: ``rows`` are (window, number of words, items)."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.lengths = np.array([n for _, n, _ in rows], np.int64)
        self.items = [items for *_, items in rows]
        self.places = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (window, *_) in enumerate(rows):
            self.places.add_word(f" {window} ", i)
        if rows:
            self.places.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, a mark for each that is hit, and the items that hit."""
        words = raw.translate(_NORMAL).split()
        marks = np.zeros(len(words), bool)
        if not words or not self.items:
            return len(words), marks, set()
        text = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape")
        found = list(self.places.iter(text))
        if not found:
            return len(words), marks, set()
        ends, which = np.array(found, np.int64).T
        blanks = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32).nonzero()[0]
        behind = np.searchsorted(blanks, ends)  # number of the word behind the window
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, behind - self.lengths[which], 1)
        np.add.at(edges, behind, -1)
        return len(words), np.cumsum(edges[:-1]) > 0, set().union(*(self.items[i] for i in np.unique(which)))


_last: tuple[str, Automaton] | None = None


def _loaded(token: str, packed: bytes) -> Automaton:
    """The automaton of a block, built once per Python worker; it replaces that of another block."""
    global _last
    if _last is None or _last[0] != token:
        _last = (token, Automaton(json.loads(zlib.decompress(packed))))
    return _last[1]


def stretches(raw: bytes, marks: np.ndarray) -> list[dict]:
    """Spans of consecutive marked words: numbers of the first and last one, and offsets in the text as given, in code points."""
    if not marks.any():
        return []
    places = [m.span() for m in _WORD.finditer(raw.decode("utf-8", "surrogateescape"))]
    turns = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))).reshape(-1, 2)
    return [dict(first=int(a), last=int(b) - 1, begin=places[a][0], end=places[b - 1][1]) for a, b in turns]


FOUND = "n_words bigint, n_hit bigint, spans array<struct<first: bigint, last: bigint, begin: bigint, end: bigint>>, items array<string>"


def _scanned(docs: DataFrame, text: str, packed) -> DataFrame:
    token = uuid.uuid4().hex

    def make():
        automaton = _loaded(token, packed.value)

        def work(texts: list[bytes]) -> list[tuple]:
            rows = []
            for raw in texts:
                n, marks, items = automaton.scan(raw)
                rows.append((n, int(marks.sum()), stretches(raw, marks), sorted(items)))
            return rows

        return work

    return add_columns(docs, text, FOUND, make)


def _merged(docs: DataFrame) -> DataFrame:
    """Spans and items of two passes in one: overlapping and adjacent spans are joined."""
    both = F.array_sort(F.concat("spans", "_spans"))

    def join(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"),
            last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    docs = docs.withColumn("spans", F.aggregate(both, F.slice(both, F.lit(1), F.lit(0)), join))
    docs = docs.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1))
    return docs.withColumn("items", F.array_sort(F.array_union("items", "_items"))).drop("_spans", "_items")


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside a window), ``spans`` (of words that are hit) and ``items`` (sorted ids) in place of ``text``."""
    spark = docs.sparkSession
    pairs = keep(windows(items, item_key, item_text, size))
    total = pairs.agg(F.sum(F.length("window") + F.length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    given = [c for c in docs.columns if c not in ("n_words", "n_hit", "spans", "items")]
    out = None
    for block in range(blocks):
        rows: dict = defaultdict(list)
        for item, n, window in pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block).toLocalIterator():
            rows[window, n].append(item)
        packed = spark.sparkContext.broadcast(zlib.compress(json.dumps([(w, n, found) for (w, n), found in rows.items()]).encode()))
        if out is None and blocks == 1:
            return _scanned(docs.select(*given), text, packed)
        held = docs.select(*given) if out is None else out.withColumnsRenamed({"spans": "_spans", "items": "_items"})
        found = _scanned(held.withColumn("_scan", F.col(text)), "_scan", packed)
        out = keep(found if out is None else _merged(found))
    return out.drop(text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))


ORACLE = rf"""
WITH asked AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pieces AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM asked WHERE len(w) > 0)
), held AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), grams AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM held, (SELECT DISTINCT k FROM pieces))
), hits AS (
  SELECT r, i, k, item FROM grams JOIN pieces USING (k, g)
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM held LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
