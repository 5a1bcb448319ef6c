"""Periodic runs of words, found by online dyadic square catching.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 * q)`` words that cannot grow on either side. Words are
appended to ``Catchers`` in pieces of any length. On level ``k`` every completed block of ``B = 2**k`` words that starts at a multiple of ``B``
sets up a catcher: it remembers the fingerprint of the ``2 * B`` words from the block's start ``a``, and watches the windows that start
``p = B .. 2 * B - 1`` words later. A window that is equal makes a square of half ``p`` (``2 * B > p`` words agree at distance ``p``). So each
appended word meets one catcher per level, and the fingerprints of a level come from two of the level below.

Why no run is missed: take the level with ``B <= q < 2 * B``. The first block that starts inside the run ends before ``2 * q`` words of it; the
catcher's ``2 * B`` words and the window ``q`` later end within ``4 * q`` words, all inside the run.

A caught square is compared word by word to both sides, and the stretch of equal distance-``p`` words is kept. Stretches that reach the last word
stay open and are compared on with the next words. A square that lies inside a stretch of smaller or equal period belongs to it, since both
periods fit into it together, and is merged; any other is a new repetition. There are fewer repetitions than words, so the work per
level stays in proportion to the words. Fingerprints only propose: every stretch is compared exactly, so none is wrong or missing by a collision.

Memory: the words as numbers, and per level the last ``2**k`` fingerprints, together a few numbers per word of the longest single text.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text. Texts may be of any length; time grows with
words times the logarithm of the longest period. Rows are independent of each other: equal rows give equal rows, null ids are kept. An empty table gives
an empty one with the same columns. Extra columns are carried along; those named like results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.llm.raw_texts import add_columns

LEAST, EXPONENT = 6, 4
#: Words that are appended at a time.
PIECE = 1 << 16
BLANKS = r"[\x20\x09-\x0D]+"
_M1, _M2, _S1, _S2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(32)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of joined windows; not linear, so that regular texts do not collide by design."""
    x = left * _M1
    x ^= x >> _S1
    x += right
    x *= _M2
    x ^= x >> _S2
    return x


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first words agree, looked up in growing steps."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        end = min(at + step, n)
        differ = (a[at:end] != b[at:end]).nonzero()[0]
        if differ.size:
            return at + int(differ[0])
        at, step = end, 2 * step
    return n


class Catchers:
    """The runs among the words appended so far."""

    def __init__(self, least: int = LEAST, exponent: int = EXPONENT):
        if exponent < EXPONENT:
            raise ValueError("catchers find repetitions of four periods and more")
        self.least, self.exponent = least, exponent
        self.held, self.n = np.empty(0, np.int64), 0
        self.levels: list[tuple[int, np.ndarray]] = []  # per level: place of the first fingerprint kept, fingerprints
        self.open: list[list[int]] = []  # stretches [start, end, period] that reach the last word
        self.runs: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        """Takes up words given as numbers; equal words must have equal numbers, different ones different."""
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.held):
            self.held = np.concatenate([self.held[:before], words, np.empty(before, np.int64)])
        else:
            self.held[before : self.n] = words
        stretches = [self._grow(x) for x in self.open]
        level, block = 0, 1
        new, first = words.astype(np.uint64) * _M2 + _M1, before  # fingerprints of the words that end in this piece
        while len(new):
            if level == len(self.levels):
                self.levels.append((first, new[:0]))
            start, kept = self.levels[level]
            here = np.concatenate([kept, new]) if len(kept) else new
            if level:  # windows of 2 * block words and their catchers, block = half of the window
                stretches += self._catch(here, start, first, block, stretches)
                block *= 2
            spare = max(0, len(here) - block)
            self.levels[level] = (start + spare, here[spare:])
            # windows twice as long; the first new one ends with the first new word
            done = start if not len(kept) else first - block
            level += 1
            new = _mix(here[max(0, done - start) : len(here) - block], here[max(0, done - start) + block :]) if len(here) > block else here[:0]
            first = max(done, start)
        self.open = [x for x in stretches if not self._close(x)]

    def _catch(self, here: np.ndarray, start: int, first: int, block: int, known: list[list[int]]) -> list[list[int]]:
        """Stretches behind the squares whose second window is one of the new ``here[first - start:]``."""
        low = max(first, block)
        count = start + len(here) - low
        if count <= 0:
            return []
        at = np.arange(low, low + count)
        catcher = (at // block - 1) * block
        caught = (here[low - start :] == here[catcher - start]).nonzero()[0]
        if not caught.size:
            return []
        at, catcher = at[caught], catcher[caught]
        order = np.argsort(at - catcher, kind="stable")
        at, catcher = at[order], catcher[order]
        for s, e, q in known:
            inside = (catcher >= s) & (at + 2 * block <= e) & (at - catcher >= q)
            if inside.any():
                at, catcher = at[~inside], catcher[~inside]
        found = []
        while at.size:
            a, p = int(catcher[0]), int(at[0] - catcher[0])
            words = self.held
            s = a - _agree(words[:a][::-1], words[p : a + p][::-1])
            e = a + p + _agree(words[a : self.n - p], words[a + p : self.n])
            if e - s >= 2 * p:
                found.append([s, e, p])
            left = (catcher < s) | (at + 2 * block > e)
            left[0] = False
            at, catcher = at[left], catcher[left]
        return found

    def _grow(self, stretch: list[int]) -> list[int]:
        s, e, p = stretch
        return [s, e + _agree(self.held[e - p : self.n - p], self.held[e : self.n]), p]

    def _close(self, stretch: list[int], last: bool = False) -> bool:
        s, e, p = stretch
        if e == self.n and not last:
            return False
        if e - s >= max(self.least, self.exponent * p):
            self.runs.append((s, e - s, p))
        return True

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period."""
        for x in self.open:
            self._close(x, last=True)
        self.open = []
        return sorted(self.runs, key=lambda r: (r[0], r[2]))


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a list of words."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return []
    catchers = Catchers(least, exponent)
    for at in range(0, len(ids), piece):
        catchers.append(ids[at : at + piece])
    return catchers.finish()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those behind the first period of a run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    return [words[i] for i in keep.nonzero()[0]]


FOUND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed`` (the words kept, joined by one blank) in place of ``text``."""

    def make():
        def work(texts: list[bytes]) -> list[tuple]:
            rows = []
            for raw in texts:
                words = raw.split()  # blanks of ASCII: exactly x20 and x09 to x0D
                runs = runs_of(words, least, exponent)
                rows.append((len(words), [dict(start=s, length=n, period=q) for s, n, q in runs], b" ".join(collapsed(words, runs))))
            return rows

        return work

    return add_columns(docs, text, FOUND, make)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which every tenth document, by the crc32 of its id, repeats a stretch of its words from some word to the end."""
    h = F.crc32(F.col(key).cast("string"))
    chosen = h % 10 == 0
    g = F.floor(h / 10)
    held = docs.withColumn("_words", F.when(chosen, F.filter(F.split(text, BLANKS), lambda w: w != "")))
    n = F.size("_words")
    held = held.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    held = held.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")))
    words = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(tail, F.lit(1), n - F.col("_a")))
    return held.withColumn(text, F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col(text))).drop("_words", "_a", "_p")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.withColumn("_best", best).select(
        key,
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(periodic_runs(planted(docs)))
