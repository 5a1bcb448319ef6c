"""WARC archives: writing with revisits, and reading in parallel by verified record boundaries.

Nothing marks where a record of a plain archive starts but the end of the record before it, and a payload may hold the text of a whole
archive. So archives are cut into ranges, and every task emits for its range the candidates it sees (the version line with a parsable
header) with the offset of their successor. Links inside a range are followed at once: a candidate then names its *exit*, the first
offset of its chain behind the range. What is left is a pointer per candidate from range to range; starting from offset 0 of each file,
pointer jumping doubles the reach in every round until the reachable entries stop growing. Candidates inside payloads are not reachable
and fall away. Afterwards each range is read once, from its verified entry.

Writing: records with equal payload (digest and length) form a group; the smallest id is its response, the others are revisits that
refer to it and carry the digest and length of the full payload but no block.

Defined results: null html is an empty payload; a null id is written without a number and reads back as null, last in its group; rows
repeated with equal id are a response and revisits to the same id; a URL of over MAX_URL characters is stored as its hash; an empty table gives an empty result; other columns are ignored. Payloads
may be of any length that a task can hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.llm.token_files import file_system
from tributary.tables import cut, keep, shared_folder, stored

MAGIC = b"WARC/1.1\r\n"
MAX_HEADER, MAX_URL = 1 << 16, 1 << 14
RANGE_BYTES = 4 << 20
#: Rows of (id, id, 20 bytes) that may be sent to every task, about 30 MB; beyond it the pages are shuffled to them.
MOST_SENT = 300_000
MOST_TASKS = 20_000
LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page, url: str, payload: bytes, first, revisit: bool) -> bytes:
    """One record with its closing blank lines; the id goes into the record's URN."""
    block = b"" if revisit else payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if len(url) > MAX_URL:
        url = f"urn:sha1:{hashlib.sha1(url.encode()).hexdigest()}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if first is None else first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _revisits(pages: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Stored (key, first, n): rows that are not the response of their payload, and how many there are.

    ``n`` is 0 where all rows of that id are revisits, 1 where one of several rows with the group's smallest id is the response."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    ids = keep(pages.select(F.col(key), F.unhex(F.sha1(payload.cast("binary"))).alias("sha"), F.octet_length(payload).alias("size")))
    order = F.struct(F.col(key).isNull(), F.col(key))
    groups = ids.groupBy("sha", "size").agg(F.min(order)[key].alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = groups.filter("rows > 1")
    several = ids.join(groups, ["sha", "size"])
    several = several.groupBy(key, "sha", "size", "first").agg(F.count(F.lit(1)).alias("n"))
    found, n, _ = cut(several.filter(~F.col(key).eqNullSafe(F.col("first")) | (F.col("n") > 1)))
    return found, n


def write_archives(pages: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """Write a record per row of ``pages`` (key, url, html); a stored table (name, size), a row per archive."""
    revisits, n = _revisits(pages, key)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(key, F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("html"))
    rows = rows.withColumn("_sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    known = revisits.select(F.col(key).alias("_key"), F.col("sha").alias("_s"), "first", F.col("n").alias("_n"))
    known = F.broadcast(known) if n <= MOST_SENT else known
    rows = rows.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_sha") == F.col("_s")), "left")
    same = F.col(key).eqNullSafe(F.col("first"))
    rows = rows.select(key, "url", "html", "first", F.when(F.col("_s").isNull(), F.lit(0)).when(same, F.lit(2)).otherwise(F.lit(1)).alias("kind"))
    once = rows.filter("kind < 2")
    # rows that repeat the id of the response itself: one of them is the response
    again = rows.filter("kind = 2").groupBy(key, "url", "html", "first").agg(F.count(F.lit(1)).alias("n"))
    if n:
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy(key, F.sha1(F.col("html").cast("binary"))).orderBy("url"))
        again = again.withColumn("at", first).select(key, "url", "html", "first", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "at")
        again = again.withColumn("kind", ((F.col("i") > 1) | (F.col("at") > 1)).cast("int")).select(*once.columns)
        once = once.unionByName(again)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        filesystem, base = file_system(folder)
        name = f"{TaskContext.get().partitionId():06d}.warc"
        own, out, size = f"{base}/{name}.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for page, url, html, first, kind in batch.itertuples(index=False):
                out = out or filesystem.open_output_stream(own)
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                data = record(page, url, html.encode(), first, bool(kind))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            filesystem.move(own, f"{base}/{name}")
            yield pd.DataFrame({"name": [name], "size": [size]})

    filesystem, base = file_system(folder)
    filesystem.create_dir(base, recursive=True)
    once = once.select(F.col(key).cast("bigint").alias(key), "url", "html", F.col("first").cast("bigint"), "kind")
    # whole numbers with nulls come as floats in pandas: send them as text
    once = once.withColumn(key, F.col(key).cast("string")).withColumn("first", F.col("first").cast("string"))
    return keep(once.mapInPandas(write, "name string, size bigint"))


def _ranges(archives: DataFrame, range_bytes: int) -> DataFrame:
    """(name, size, at): a row per range, a task each."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = archives.filter("size > 0").select("name", "size", F.explode(starts).alias("at"))
    return _dealt(keep(ranges))


def _dealt(rows: DataFrame) -> DataFrame:
    """Stored rows dealt out by number; what is dealt by a key only may be put together again."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)))


def _header(data: bytes, at: int) -> tuple[bytes, int, int] | None:
    """(header, start of block, length of block) of a record that starts at ``at``; None if there is none."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at, at + MAX_HEADER)
    length = LENGTH.search(data, at, end + 2) if end >= 0 else None
    return (data[at : end + 2], end + 4, int(length[1])) if length else None


def candidates(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Stored (name, offset, exit): everything that looks like a record, with the first offset of its chain behind its range.

    A chain that meets something else than a record before that has no exit."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = file_system(folder)
        for batch in batches:
            for name, size, at in batch.itertuples(index=False):
                with filesystem.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(min(range_bytes + MAX_HEADER, size - at), at)
                successors, place = {}, data.find(MAGIC)
                while 0 <= place < range_bytes:
                    found = _header(data, place)
                    if found:
                        successors[place] = found[1] + found[2] + 4
                    place = data.find(MAGIC, place + 1)
                exits: dict[int, int | None] = {}
                for place in sorted(successors, reverse=True):
                    after = successors[place]
                    exits[place] = after if after >= min(range_bytes, size - at) else exits.get(after)
                kept = [(name, at + p, at + e) for p, e in exits.items() if e is not None and at + e <= size]
                if kept:
                    yield pd.DataFrame(kept, columns=["name", "offset", "exit"])

    return keep(_ranges(archives, range_bytes).mapInPandas(scan, "name string, offset bigint, exit bigint"))


def entries(found: DataFrame) -> DataFrame:
    """(name, offset): the candidates that a chain from offset 0 enters a range by. Pointer jumping: each round follows twice as far."""
    spark, schema = found.sparkSession, "name string, offset bigint"
    jump = found
    reached, _, path = cut(found.filter("offset = 0").select("name", "offset"))
    paths, new = [path], reached
    reached, grown = stored(spark, schema, paths), True
    while grown:
        step = reached.join(jump, ["name", "offset"]).select("name", F.col("exit").alias("offset"))
        step = step.join(found.select("name", "offset"), ["name", "offset"], "left_semi").distinct()
        new, grown, path = cut(step.join(reached, ["name", "offset"], "left_anti"))
        if grown:
            paths.append(path)
            reached = stored(spark, schema, paths)
            far = jump.select("name", F.col("offset").alias("exit"), F.col("exit").alias("far"))
            jump = keep(jump.join(far, ["name", "exit"]).select("name", "offset", F.col("far").alias("exit")))
    return reached


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every reachable record.

    Without ``payloads`` they are read and digested, but not handed on."""
    starts = entries(candidates(archives, folder, range_bytes))
    number = re.compile(rb"<urn:page:(-?\d*)>")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = file_system(folder)
        for batch in batches:
            for name, size, start in batch.itertuples(index=False):
                stop, at = min(size, (start // range_bytes + 1) * range_bytes), start
                with filesystem.open_input_file(f"{base}/{name}") as f:
                    data, shift, rows, held = f.read_at(min(stop - at + MAX_HEADER, size - at), at), start, [], 0
                    while at < stop:
                        header, block, length = _header(data, at - shift)
                        whole = data[block : block + length]
                        if len(whole) < length:
                            whole = f.read_at(length, shift + block)
                        fields = dict(line.split(b": ", 1) for line in header.split(b"\r\n")[1:] if line)
                        revisit = fields[b"WARC-Type"] == b"revisit"
                        ids = [number.search(fields.get(k, b"<urn:page:>"))[1] for k in (b"WARC-Record-ID", b"WARC-Refers-To")]
                        full = int(fields[b"X-Payload-Length"]) if revisit else length
                        sha = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:") if revisit else digest(whole)
                        rows.append((ids[0].decode() or None, fields[b"WARC-Target-URI"].decode(), full, sha, "revisit" if revisit else "response", ids[1].decode() or None, None if revisit or not payloads else whole))
                        held += length
                        at = shift + block + length + 4
                        if held > range_bytes:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    walks = _dealt(keep(starts.join(archives, "name").filter("offset < size").select("name", "size", "offset")))
    read_back = walks.mapInPandas(read, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    return read_back.withColumn("page_id", F.col("page_id").cast("bigint")).withColumn("refers_to", F.col("refers_to").cast("bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    read_back = read_archives(write_archives(pages, folder), folder, payloads=False)
    return read_back.drop("url", "payload")
