"""Motion-JPEG in AVI: RIFF index, intra frames, shots by adaptive histogram differences.

Frames are 8-bit grey images coded by lossless JPEG (SOF3: Huffman-coded differences to the left neighbour, at the start of a line to the
sample above it). A Huffman code is free to choose; the one written here gives a difference of ``s`` significant bits a code of ``9 - s``
bits, so that every sample takes exactly nine bits and whole frames are packed and unpacked as arrays. The reader takes the code table
from the frame, as any decoder does, and accepts every table with that property; others are refused, as are lossy frames.

A payload of bytes becomes samples of WIDTH x HEIGHT frames, the last one filled with zeros; its length stands in the INFO list. Reading
goes by the ``idx1`` index to each frame chunk. A shot starts where the histogram difference of neighbouring frames exceeds the mean of
the last WINDOW differences by DEVIATIONS standard deviations, and FLOOR.

Defined results: null text is an empty payload, one block of zeros; equal texts give equal files; repeated rows give equal rows; an empty
table gives an empty result; extra columns are ignored by the query and carried by ``clips`` under their names. Texts
may be of any length up to what one file holds in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

WIDTH, HEIGHT, RATE = 64, 16, 25
FRAME = WIDTH * HEIGHT
BLOCK = 64
BINS, WINDOW, DEVIATIONS, FLOOR = 16, 8, 3.0, 0.1
BITS = 9


# lossless JPEG


def _code_table() -> tuple[bytes, np.ndarray, np.ndarray]:
    """(DHT segment, nine-bit code of each difference -255..255, difference of each nine-bit code)."""
    # category 8 has one bit, category 0 nine: canonical codes 0, 10, 110, ... and the bits of the difference behind
    lengths = [1] * BITS + [0] * (16 - BITS)
    segment = b"\xff\xc4" + struct.pack(">HB", 3 + 16 + BITS, 0) + bytes(lengths) + bytes(range(8, -1, -1))
    return segment, *_tables(segment)


def _tables(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and differences from a DHT segment. Every symbol ``s`` must have a code of ``9 - s`` bits."""
    lengths, symbols = segment[5:21], segment[21:]
    encode, decode = np.zeros(511, np.uint16), np.zeros(1 << BITS, np.int16)
    code, at = 0, 0
    for size, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            if size + s != BITS:
                raise ValueError("samples of this Huffman table differ in length")
            for extra in range(1 << s):
                difference = 0 if s == 0 else extra if extra >= 1 << (s - 1) else extra - (1 << s) + 1
                word = code << s | extra
                encode[difference + 255], decode[word] = word, difference
            code += 1
        code, at = code << 1, at + n
    return encode, decode


DHT, ENCODE, DECODE = _code_table()


def _headers(width: int, height: int) -> bytes:
    """What stands before the coded samples of a frame."""
    frame = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
    return b"\xff\xd8" + frame + DHT + scan


HEADERS = _headers(WIDTH, HEIGHT)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of (frames, HEIGHT, WIDTH) samples."""
    before = np.empty(samples.shape, np.int16)
    before[:, :, 1:] = samples[:, :, :-1]
    before[:, 1:, 0] = samples[:, :-1, 0]
    before[:, 0, 0] = 128
    codes = ENCODE[samples - before + 255].reshape(-1, 8).astype(np.uint64)
    # eight samples are nine bytes: the first 64 bits, and the low byte of the last sample
    high = np.zeros(len(codes), np.uint64)
    for i in range(7):
        high |= codes[:, i] << np.uint64(55 - 9 * i)
    high |= codes[:, 7] >> np.uint64(8)
    packed = np.empty((len(codes), 9), np.uint8)
    packed[:, :8] = high.astype(">u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8] = (codes[:, 7] & np.uint64(255)).astype(np.uint8)
    size = FRAME * BITS // 8
    data = packed.tobytes()
    return [HEADERS + data[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(data), size)]


def decode_frames(files: list[bytes]) -> np.ndarray:
    """(frames, height, width) samples of JPEG files that share their headers' content."""
    scans, shape, decode, known = [], None, None, None
    for data in files:
        if known is not None and data.startswith(known):
            start = len(known)
        else:
            shape_here, table, start = _parse(data)
            if shape is not None and shape_here != shape:
                raise ValueError("frames differ in size")
            shape, decode, known = shape_here, table, data[:start]
        scans.append(data[start : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"))
    height, width = shape
    size = (height * width * BITS + 7) // 8
    if any(len(x) != size for x in scans):
        raise ValueError("a frame is cut")
    packed = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 9)
    high = packed[:, :8].copy().view(">u8").astype(np.uint64)[:, 0]
    codes = np.empty((len(packed), 8), np.uint16)
    for i in range(7):
        codes[:, i] = (high >> np.uint64(55 - 9 * i)) & np.uint64(511)
    codes[:, 7] = ((high & np.uint64(1)) << np.uint64(8)) | packed[:, 8]
    differences = decode[codes].reshape(len(files), height, width).astype(np.uint8)
    differences[:, 0, 0] += np.uint8(128)
    # the first sample of each line adds up from the line above, the others from the left; all modulo 256
    differences[:, :, 0] = np.cumsum(differences[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(differences, axis=2, dtype=np.uint8)


def _parse(data: bytes) -> tuple[tuple[int, int], np.ndarray, int]:
    """((height, width), differences of codes, start of the coded samples)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, shape, decode = 2, None, None
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xC3:
            shape = struct.unpack_from(">HH", data, at + 5)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("only lossless frames hold samples as they were")
        elif marker == 0xC4:
            decode = _tables(data[at : at + 2 + size])[1]
        at += 2 + size
        if marker == 0xDA:
            return shape, decode, at


# RIFF


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of one video stream whose samples are ``payload``."""
    filled = -len(payload) % FRAME
    samples = np.frombuffer(payload + b"\0" * filled, np.uint8).reshape(-1, HEIGHT, WIDTH)
    frames = encode_frames(samples)
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    lists += _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    index, movie, at = [], [b"movi"], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movie.append(_chunk(b"00dc", frame))
        at += len(movie[-1])
    body = b"AVI " + lists + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """(frame files by the index, frames per second, bytes of the payload if it says so)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, rate, length, movie = [], float(RATE), None, None

    def walk(at: int, end: int) -> None:
        nonlocal rate, length, movie, frames
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movie = at + 8
            elif name == b"LIST":
                walk(at + 12, at + 8 + size)
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 28)
                rate = per / max(1, scale)
            elif name == b"ICMT":
                length = int(data[at + 8 : at + 8 + size].rstrip(b"\0").removeprefix(b"payload_bytes="))
            elif name == b"idx1":
                for i in range(at + 8, at + 8 + size, 16):
                    kind, _, offset, n = struct.unpack_from("<4sIII", data, i)
                    if kind[2:] in (b"dc", b"db"):
                        frames.append(data[movie + offset + 8 : movie + offset + 8 + n])
            at += 8 + size + size % 2

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    return frames, rate, length


def shots(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first frames of the shots, histogram difference of each frame to the one before; 0 for the first)."""
    n = len(samples)
    cell = (samples.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    histograms = np.bincount(cell.ravel(), minlength=n * BINS).reshape(n, BINS) / samples[0].size
    difference = np.concatenate([[0.0], np.abs(np.diff(histograms, axis=0)).sum(1) / 2])
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (difference, difference**2))
    at = np.arange(n)
    since = np.maximum(1, at - WINDOW)
    count = np.maximum(1, at - since)
    mean = (sums[at] - sums[np.minimum(since, at)]) / count
    deviation = np.sqrt(np.maximum(0, (squares[at] - squares[np.minimum(since, at)]) / count - mean**2))
    cut = (difference > mean + DEVIATIONS * deviation) & (difference > FLOOR)
    cut[0] = True
    return np.flatnonzero(cut), difference


CLIP = "clip int, start_s double, end_s double, n_frames int, mean_luma double, max_difference double"


def clip_rows(data: bytes) -> tuple[bytes, list[tuple]]:
    """(the payload as read back, timed clips) of a stored file."""
    frames, rate, length = read_avi(data)
    samples = decode_frames(frames)
    first, difference = shots(samples)
    ends = np.append(first[1:], len(samples))
    means = samples.reshape(len(samples), -1).mean(1)
    rows = [(i, a / rate, b / rate, int(b - a), float(means[a:b].mean()), float(difference[a + 1 : b].max(initial=0.0))) for i, (a, b) in enumerate(zip(first.tolist(), ends.tolist()))]
    return samples.tobytes()[:length], rows


def clips(media: DataFrame, column: str = "media") -> DataFrame:
    """A row per shot of every AVI file in ``column``, other columns beside it."""
    others = [c for c in media.columns if c != column]

    def cut(files: pd.Series) -> pd.Series:
        return pd.Series([[] if f is None else clip_rows(f)[1] for f in files], dtype=object)

    names = "array<struct<%s>>" % ",".join(x.strip().replace(" ", ":") for x in CLIP.split(","))
    found = media.select(*others, F.explode(F.pandas_udf(cut, names)(column)).alias("_clip"))
    return found.select(*others, "_clip.*")


def padded(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "replace")
    return data + b"\0" * (-len(data) % BLOCK or BLOCK * (not data)), len(data)


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips int"


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as an AVI file, read it back, and describe both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, value in zip(batch["key"], batch["text"]):
                payload, n = padded(value)
                media = write_avi(payload)
                back, found = clip_rows(media)
                feature = ";".join(f"{a:.2f}-{b:.2f}:{luma:.3f}:{top:.4f}" for _, a, b, _, luma, top in found)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found)))
            yield pd.DataFrame(rows, columns=["key", *[x.split()[0] for x in DIGEST.split(", ")[1:]]])

    rows = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.mapInPandas(run, DIGEST.replace("doc_id bigint", "key string"))
    return found.select(F.col("key").cast("bigint").alias(key), *[x.split()[0] for x in DIGEST.split(", ")[1:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
