"""Token ids as flat binary files: unsigned integers one after another, 64-bit document offsets beside them.

A shard is three little-endian files of nothing but numbers: ``.bin`` (ids, 16 bits where the vocabulary fits, else 32), ``.idx``
(64-bit offsets, one more than documents) and ``.doc`` (64-bit document ids). Shards follow each other in order of document id; the place
of a shard's first id among all ids is the prefix sum of the counts before it, so the offsets of a shard never have to be rewritten.

Spark sorts the documents by id into ranges and every task writes one shard, document by document, under a name of its own attempt that
is moved into place when complete: a lost executor's task simply writes again. Files go to any file system that pyarrow opens by
address; readers map local ones into memory and read ranges of others.

Defined results: null text is an empty text, which still has its end id; a null id sorts first and reads back as null (a flag beside the
id); repeated rows are encoded each; an empty table gives no shards and an empty result; further columns are ignored. Texts may be of any
length: long ones are cut before blanks, unless white space of other kinds or the name of a special token forbids it.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.llm.known import kept
from tributary.tables import keep, shared_folder

NULL_ID = np.iinfo(np.int64).min
#: Texts are cut before blanks and line ends. The byte-level split rule cuts there too, unless three of them follow each other or two end a text.
RUNS = tuple(map("".join, itertools.product(" \n", repeat=3)))
ENDS = tuple(map("".join, itertools.product(" \n", repeat=2)))
#: So are not texts with other white space, or with what may be a special token: they are encoded in one call.
WHOLE = re.compile(r"[^\S \n]|[᠎​﻿]|<\|")
IN_ONE = 1
#: Marks that the split rule separates from a word of Latin letters before them.
MARKS, LATIN_END = ".,;:!?", "\u0250"
#: Bytes of ids that a task reads back.
READ_BYTES, MOST_TASKS = 16 << 20, 20_000
CACHE_UNITS, CACHE_MARKS, BATCH_CHARS, JOINED, LONGEST, SEGMENT = 1_500_000, 100_000, 2_000_000, 1000, 1 << 16, 1_000_000
#: A byte that no text in UTF-8 holds.
END_OF_TEXT = b"\xff"


def file_system(address: str):
    """(pyarrow file system, path) of a folder given as address or plain path."""
    from pyarrow import fs

    if not urlsplit(address).scheme:
        return fs.LocalFileSystem(), address
    return fs.FileSystem.from_uri(address)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start .. start + count - 1`` of every range, one after the other."""
    after = np.cumsum(counts)
    return np.arange(int(after[-1]) if len(after) else 0) + np.repeat(starts - (after - counts), counts)


class Encoder:
    """Ids by the tokenizers library, each distinct piece once while it stays in a cache of bounded size.

    A piece is a blank or line end with what follows it, or what a text begins with. The pieces of many texts are hashed and numbered together; a number's
    bytes are looked up once, and all pieces are compared with those of their number, so that equal hashes prove nothing.
    """

    def __init__(self, tokenizer_file: str, dtype: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(tokenizer_file), np.dtype(dtype)
        self.marks: dict[str, np.ndarray] = {}
        self.weights = np.random.default_rng(1).integers(1, 2**63, LONGEST, np.uint64) | np.uint64(1)
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for piece, i in vocabulary.items() if piece[0] == "Ġ"]] = True

    def _forget(self) -> None:
        """Start the cache anew: a piece's number, and by number its place and length among the ids of all."""
        self.known: dict[bytes, int] = {END_OF_TEXT: 0}
        self.places, self.counts, self.ids = np.zeros(2, np.int64), np.array([0, -1], np.int64), np.zeros(0, self.dtype)
        #: number 0 has no ids; number IN_ONE is that of all pieces that may not stand alone

    def _add(self, pieces: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.counts)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.places = np.concatenate([self.places, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _joined_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of units that are a blank and a word: many are encoded as one text, in which a piece with a blank begins each of them."""
        counts, found = [], []
        for i in range(0, len(units), JOINED):
            some = units[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.starts[ids])
            if len(starts) == len(some):
                counts.append(np.diff(np.append(starts, len(ids))))
                found.append(ids)
            else:
                each = self._ids(some)
                counts.append(np.array([len(x) for x in each], np.int64))
                found += each
        return np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, self.dtype), *found])

    def _learn(self, new: list[bytes]) -> None:
        known, words, raw_words, others, marked = self.known, [], [], [], []
        for raw in new:
            piece = raw.decode()
            body = piece[1:] if piece[0] == " " else ""
            if body.isalpha():
                words.append(piece)
                raw_words.append(raw)
                continue
            base = body.rstrip(MARKS)
            if base.isalpha() and (base.isascii() or max(base) < LATIN_END):
                marks = body[len(base) :]
                marked.append((raw, raw[: -len(marks)], marks))
            elif WHOLE.search(piece):
                known[raw] = IN_ONE
            elif body:
                words.append(piece)
                raw_words.append(raw)
            else:
                others.append(piece)
        # a word and the marks behind it are split by rule, and the word is often known
        bases = {base for _, base, _ in marked}.difference(known, raw_words)
        self._add(raw_words + list(bases), *self._joined_ids(words + [b.decode() for b in bases]))
        each = self._ids(others)
        self._add([p.encode() for p in others], np.array([len(x) for x in each], np.int64), np.concatenate([np.zeros(0, self.dtype), *each]))
        if marked:
            if len(self.marks) > CACHE_MARKS:
                self.marks = {}
            marks = list({m for *_, m in marked}.difference(self.marks))
            self.marks.update(zip(marks, self._ids(marks)))
            numbers = np.fromiter((known[base] for _, base, _ in marked), np.int64, len(marked))
            behind = [self.marks[m] for *_, m in marked]
            counts, more = self.counts[numbers], np.array([len(x) for x in behind], np.int64)
            ends = np.cumsum(counts + more)
            ids = np.empty(int(ends[-1]), self.dtype)
            ids[_ranges(ends - more - counts, counts)] = self.ids[_ranges(self.places[numbers], counts)]
            ids[_ranges(ends - more, more)] = np.concatenate(behind)
            self._add([raw for raw, *_ in marked], counts + more, ids)

    def _numbered(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of every piece, place of the first piece of every number)."""
        offsets = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
        hashes = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * self.weights[offsets % LONGEST], starts) + lengths.astype(np.uint64) * self.weights[0]
        numbers, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        like = first[numbers]
        # a place beyond the raw bytes belongs to a piece of other length, which differs anyway
        same = (lengths == lengths[like]).all() and (raw[np.minimum(np.repeat(starts[like], lengths) + offsets, len(raw) - 1)] == raw).all()
        if not same:
            texts = [raw[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
            numbers, distinct = pd.factorize(pd.Series(texts, dtype=object))
            first = np.empty(len(distinct), np.int64)
            first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        return numbers, first

    def _encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts that may be cut; None for one with a piece that may not stand alone."""
        data = b"".join([t.encode() + END_OF_TEXT for t in texts])
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == END_OF_TEXT[0])
        begins = (raw == 32) | (raw == 10)
        begins[ends] = True
        begins[0] = True
        begins[ends[:-1] + 1] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(raw)))
        numbers, first = self._numbered(raw, starts, lengths)
        distinct = [data[a : a + n] for a, n in zip(starts[first].tolist(), lengths[first].tolist())]
        if len(self.known) > CACHE_UNITS:
            self._forget()
        held = list(map(self.known.get, distinct))
        missing = [i for i, k in enumerate(held) if k is None]
        new = [distinct[i] for i in missing]
        self._learn(new)
        for i, piece in zip(missing, new):
            held[i] = self.known[piece]
        number = np.array(held, np.int64)
        bad, counts = number == IN_ONE, np.maximum(self.counts[number], 0)[numbers]
        after = np.cumsum(counts)
        out = self.ids[_ranges(self.places[number][numbers], counts)].tobytes()
        at_end = np.searchsorted(starts, ends)
        stops = after[at_end] * self.dtype.itemsize
        spoilt = np.add.reduceat(bad[numbers], np.concatenate([[0], at_end[:-1] + 1])) > 0
        begin, result = 0, []
        for stop, no in zip(stops.tolist(), spoilt.tolist()):
            result.append(None if no else out[begin:stop])
            begin = stop
        return result

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts, at = [], []
        for i, t in enumerate(texts):
            if not (any(run in t for run in RUNS) or t.endswith(ENDS)):
                begin = 0
                while len(t) - begin > SEGMENT and (cut := t.find(" ", begin + SEGMENT)) > 0:
                    parts.append(t[begin:cut])
                    at.append(i)
                    begin = cut
                parts.append(t[begin:] if begin else t)
                at.append(i)
        found: list[list[bytes] | None] = [None] * len(texts)
        for i, ids in zip(at, self._encode(parts) if parts else []):
            found[i] = [*(found[i] or []), ids]
        return [self._ids([t])[0].tobytes() if x is None or None in x else b"".join(x) if len(x) > 1 else x[0] for t, x in zip(texts, found)]


def _chunks(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BATCH_CHARS characters, so that a batch of long texts is never held as ids at once."""
    start, held, chars = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t if isinstance(t, str) else "")
        chars += len(held[-1])
        if chars >= BATCH_CHARS:
            yield start, held
            start, held, chars = i + 1, [], 0
    if held:
        yield start, held


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, vocabulary: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` into shards under ``folder``; a stored table (shard, first, n_docs, n_tokens), a row per shard."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), None
        filesystem, base = file_system(folder)
        name = f"{base}/{shard:06d}"
        own = f"{name}.{uuid.uuid4().hex}"
        out, ids, lengths, first = None, [], [], None
        for batch in batches:
            if out is None and len(batch):
                encode, out, first = kept(Encoder, tokenizer_file, dtype), filesystem.open_output_stream(f"{own}.bin"), batch["id"].iloc[0]
            ids.append(batch["id"].to_numpy(np.int64))
            for _, texts in _chunks(batch["text"]):
                for found in encode(texts):
                    data = found + np.array([end_id], dtype).tobytes()
                    out.write(data)
                    lengths.append(len(data) // int(dtype[-1]))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        for kind, values in (("idx", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with filesystem.open_output_stream(f"{own}.{kind}") as f:
                f.write(values.tobytes())
        for kind in ("bin", "idx", "doc"):
            filesystem.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pd.DataFrame({"shard": [shard], "first": [first], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

    filesystem, base = file_system(folder)
    filesystem.create_dir(base, recursive=True)
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(int(NULL_ID))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.repartitionByRange("id").sortWithinPartitions("id")
    return keep(placed.mapInPandas(write, "shard int, first bigint, n_docs bigint, n_tokens bigint"))


def with_bases(shards: DataFrame) -> DataFrame:
    """``shards`` with ``base``, the number of ids in all shards before: a prefix sum over a row per shard, not per document."""
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


class Shard:
    """A shard's numbers: mapped into memory from a local folder, read by range from elsewhere."""

    def __init__(self, folder: str, shard: int, dtype: str):
        from pyarrow import fs

        self.filesystem, base = file_system(folder)
        self.name, self.dtype = f"{base}/{shard:06d}", np.dtype(dtype)
        self.offsets, self.docs = (np.frombuffer(self._all(kind), "<i8") for kind in ("idx", "doc"))
        local = isinstance(self.filesystem, fs.LocalFileSystem)
        self.mapped = np.memmap(f"{self.name}.bin", self.dtype, "r") if local else None
        self.file = None if local else self.filesystem.open_input_file(f"{self.name}.bin")

    def _all(self, kind: str) -> bytes:
        with self.filesystem.open_input_file(f"{self.name}.{kind}") as f:
            return f.read()

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        if self.mapped is not None:
            return self.mapped[a:b]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * size, a * size), self.dtype)


def read_shards(shards: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """Per document, read back from the files: (doc_id, start, n_tokens, ids_crc32)."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, base, start, end in zip(batch["shard"], batch["base"], batch["start"], batch["end"]):
                shard = Shard(folder, int(number), dtype)
                for at in range(start, end, 10_000):
                    some = range(at, min(at + 10_000, end))
                    crc = [zlib.crc32(np.ascontiguousarray(shard[i], "<u4").data) for i in some]
                    ids = shard.docs[some.start : some.stop]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.Series(ids).astype("Int64").mask(ids == NULL_ID),
                            "start": int(base) + shard.offsets[some.start : some.stop],
                            "n_tokens": np.diff(shard.offsets[some.start : some.stop + 1]),
                            "ids_crc32": np.array(crc, np.int64),
                        }
                    )

    # a row per range of a shard's documents, dealt out by number: what is named by a key only may be put together again
    parts = F.ceil(F.col("n_tokens") * int(dtype[-1]) / READ_BYTES)
    ranges = with_bases(shards).withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    edge = lambda i: F.floor(F.col("n_docs") * i / F.col("parts")).cast("bigint")
    ranges = keep(ranges.select("shard", "base", edge(F.col("i")).alias("start"), edge(F.col("i") + 1).alias("end")))
    spread = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))
    return spread.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


TOKENIZER, VOCABULARY, END = "byte_bpe_50k.json", 50_257, 0


def encode_table(spark: SparkSession, docs: DataFrame, tokenizer_file: str, vocabulary: int, end_id: int = 0) -> DataFrame:
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, folder, tokenizer_file, vocabulary, end_id), folder, vocabulary)


def query(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(TOKENIZER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_table(spark, docs, tokenizer_file, VOCABULARY, END)
