"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (blanks become marks in front of the next word), which no piece used here crosses, so the best
segmentation of a text is that of its words. The distinct words of a stretch of texts are sorted, which is a depth-first walk of their
trie: a word keeps the forward scores of the prefix it shares with the word before and only extends them behind it. The pieces that end at a place are
found by walking back from it in a trie of reversed pieces, as far as any piece goes. Segmentation
maximises the sum of piece scores; equal sums go to the longer last piece. Characters without a piece are spelt in byte pieces.

Pieces come from a model file of the sentencepiece library. The scores of a merge model are ranks; they are read as Zipf's law,
``log p = -ln(rank + ZIPF)``; those of a unigram model are taken as they are.

Encoding is reversible: blanks and line ends are kept one by one, and the mark itself, where a text holds it, is spelt in bytes.

Spark deals out the texts, tasks need no state but the pieces and a cache of bounded size, and no rows move.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows give equal rows; an empty table gives an
empty result; other columns pass through ``encode`` and ``decode``, unless they are called like the result column, which wins. Texts may be of any
length; a word costs its length times that of the longest piece.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tributary.llm.known import Known, kept, tidy

MARK = "▁"
ZIPF, UNKNOWN_PENALTY = 2.7, 10.0
#: With a blank put before the text: words with the blanks before them, blanks before none, line ends, literal marks.
UNIT = re.compile(r" *[^ \n▁]+| +|\n|▁")
CACHE_WORDS, BATCH_CHARS = 150_000, 1_000_000


def _without_own_leaves(node: list, empty: dict) -> None:
    """All nodes that nothing stands before share one empty dictionary."""
    for below in node[0].values():
        _without_own_leaves(below, empty)
    node[0] = node[0] or empty


class Pieces:
    """Scores and ids of a model file, ready for segmentation; made once per task."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        ranks = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        merges = all(float(s).is_integer() for _, _, s in ranks)
        for i, piece, score in ranks:
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.text.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
            # pieces that hold a mark behind other characters would cross words
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or MARK in piece.lstrip(MARK)):
                self.ids[piece] = (-math.log(-score + ZIPF) if merges else score, i)
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        #: a node is [nodes by the character before, score, id], the last two of the piece that begins here, if one does
        self.ending: list = [{}, None, -1]
        for piece, (score, i) in self.ids.items():
            node = self.ending
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None, -1])
            node[1:] = score, i
        _without_own_leaves(self.ending, {})
        self.unknown = min(s for s, _ in self.ids.values()) - UNKNOWN_PENALTY

    def spell(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()]

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of every word, in sorted order; scores along the path from the trie's root are kept on a stack."""
        ids, ending, unknown = self.ids, self.ending, self.unknown
        best, back, path = [0.0], [(0, 0)], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                most, step, node, start = -math.inf, None, ending, end
                while start:
                    start -= 1
                    node = node[0].get(word[start])
                    if node is None:
                        break
                    if node[1] is not None and (score := best[start] + node[1]) >= most:
                        most, step = score, (start, node[2])
                if word[end - 1] not in ids and best[end - 1] + unknown > most:
                    most, step = best[end - 1] + unknown, (end - 1, -1)
                best.append(most)
                back.append(step)
            path, at, found = word, len(word), []
            while at:
                start, piece = back[at]
                found.append([piece] if piece >= 0 else self.spell(word[start:at]))
                at = start
            yield word, [i for x in reversed(found) for i in x]

    def decode(self, ids: Iterable[int]) -> str:
        text = self.text
        return b"".join([text[i] for i in ids]).decode("utf-8", "replace")[1:]


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit integers."""

    def __init__(self, model_file: str):
        self.pieces, self.known = kept(Pieces, model_file), Known(CACHE_WORDS)

    def __call__(self, texts: list[str]) -> list[bytes]:
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        known = self.known
        new = set(known.missing(set().union(*units)))
        for unit in new & {MARK, "\n"}:
            known[unit] = np.array(self.pieces.spell(unit), "<u4").tobytes()
        marked = {u.replace(" ", MARK): u for u in new - {MARK, "\n"}}
        for word, ids in self.pieces.segment(marked):
            known[marked[word]] = np.array(ids, "<u4").tobytes()
        return [b"".join([known[u] for u in x]) for x in units]


def _chunks(texts: Iterable) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        held.append((t.as_py() if isinstance(t, pa.Scalar) else t) or "")
        chars += len(held[-1])
        if chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``. A task hands over the ids of about BATCH_CHARS characters at a time."""
    others = [c for c in docs.columns if c not in (text, ids)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(Encoder, model_file)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(batch.num_columns - 1)):
                found = encoder(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<i4")))
                rest = batch.slice(at, len(texts)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=[*others, ids])
                at += len(texts)

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = kept(Pieces, model_file)
        for batch in batches:
            yield pd.Series(["" if x is None else pieces.decode(x.tolist()) for x in batch], dtype=object)

    others = [c for c in encoded.columns if c not in (text, ids)]
    return encoded.select(*others, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(ids).alias(text))


DIGEST = "n_tokens bigint, ids_crc32 bigint, decoded_bytes bigint, decoded_sha256 string, round_trip boolean"


def digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its ids' number and crc32 (of little-endian unsigned 32-bit integers), and the text decoded from them."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = kept(Encoder, model_file)
        for batch in batches:
            rows = []
            for texts in _chunks(batch):
                for given, data in zip(texts, encoder(texts)):
                    back = encoder.pieces.decode(np.frombuffer(data, "<u4").tolist())
                    raw = back.encode()
                    rows.append((len(data) // 4, zlib.crc32(data), len(raw), hashlib.sha256(raw).hexdigest(), back == given))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])

    described = F.pandas_udf(run, DIGEST, F.PandasUDFType.SCALAR_ITER)(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, described.alias("_d")).select(key, "_d.*")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, model_file or model_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: documents with ids in place of their text."""
    return encode(docs, model_path())
