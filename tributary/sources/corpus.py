"""Reading corpora, manifests and samples, and writing reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.fixpoint import GROUP
from tributary.functions.scalar import printable_string
from tributary.operators.predicates import contains_any
from tributary.schema import schema_of

# fixed values: helper functions that compilers and the C runtime add
BLOCKLIST = (
    "_init",
    "_fini",
    "_start",
    "__cxa_finalize",
    "__x86.get_pc_thunk.bx",
    "deregister_tm_clones",
    "register_tm_clones",
    "__do_global_dtors_aux",
    "frame_dummy",
    "__x86.get_pc_thunk.dx",
    "__libc_start_main",
    "__libc_csu_init",
    "__libc_csu_fini",
    "__x86.get_pc_thunk.bp",
)
IMPORTED = "ImportedFunctionSymbol"


def write_corpus(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per entry, with the corpus columns; missing ones are null."""
    for name, df in tables.items():
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(name).fields]
        df.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_corpus(spark: SparkSession, folder: str, names: Sequence[str] = ("functions", "blocks", "edges", "instr")) -> dict[str, DataFrame]:
    """The tables of a corpus. A constant jump that ends a block with one out-edge says nothing new, so it is left out of ``instr``."""
    tables = {name: spark.read.schema(schema_of(name)).parquet(f"{folder}/{name}") for name in names}
    if {"edges", "instr"} <= tables.keys():
        outs = tables["edges"].groupBy(GROUP, F.col("src").alias("block")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
        last = tables["instr"].groupBy(GROUP, "block").agg(F.max_by(F.struct("idx", "kind", "opcode"), "idx").alias("l"))
        jumps = last.filter("l.kind = 'jump' AND l.opcode = 'constant'").select(GROUP, "block", F.col("l.idx").alias("idx"))
        tables["instr"] = tables["instr"].join(jumps.join(outs, [GROUP, "block"], "left_semi"), [GROUP, "block", "idx"], "left_anti")
    return tables


def list_functions(functions: DataFrame, blocklist: Sequence[str] = BLOCKLIST) -> DataFrame:
    """Functions worth a look: not on the list of helpers and not imported. What has no name or no type is neither."""
    return functions.filter(_analysable(blocklist))


def _analysable(blocklist: Sequence[str]) -> Column:
    return ~F.coalesce(F.col("name").isin(*blocklist), F.lit(False)) & ~F.col("symbol_type").eqNullSafe(IMPORTED)


def resolve_functions(functions: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(id)`` with the function they name: by exact name, else by address in hexadecimal, possibly after ``sub_``; else null.

    Addresses have 64 bits; from 2**63 on they are stored as the negative number of the same bits.
    """
    named = functions.groupBy(F.col("name").alias("id")).agg(F.min("func_id").alias("by_name"))
    digits = F.regexp_replace("id", "^sub_", "")
    digits = F.regexp_extract(digits, "^(?:0[xX])?0*([0-9a-fA-F]{1,16})$", 1)
    asked = ids.withColumn("_at", F.when(digits != "", F.conv(digits, 16, -10).cast("bigint")))
    placed = functions.groupBy(F.col("address").alias("_at")).agg(F.min("func_id").alias("by_address"))
    out = asked.join(named, "id", "left").join(placed, "_at", "left")
    return out.select(*ids.columns, F.coalesce("by_name", "by_address").alias("func_id"))


def small_functions(blocks: DataFrame, max_blocks: int = 15) -> DataFrame:
    """Blocks of the functions that have at most ``max_blocks``."""
    fit = blocks.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_blocks)
    return blocks.join(fit, GROUP, "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample, function) per line, separated by white space; empty lines do not count."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(parts[0].alias("sample"), parts[1].alias("function"))


TEST_FUNCTION = r"^\w+ (test\d+)\(.*\)"


def scan_source(spark: SparkSession, path: str, pattern: str = TEST_FUNCTION) -> DataFrame:
    """(file, name) of every line that begins with a function of the pattern."""
    found = F.regexp_extract("value", pattern, 1)
    return spark.read.text(path).select(F.input_file_name().alias("file"), found.alias("name")).filter("name <> ''")


def match_by_suffix(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, source) where the file's name ends with the source's.

    Instead of comparing all with all, every file is looked up by its endings of the lengths that sources have: an equi join. Lengths
    above the longest file name cannot match, so there are at most as many as that name has characters.
    """
    longest = files.agg(F.max(F.length("file"))).first()[0] or 0
    rows = sources.select(F.length("source").alias("n")).filter(F.col("n") <= longest).distinct().collect()
    lengths = F.array(*[F.lit(r[0]) for r in sorted(rows)]) if rows else F.array().cast("array<int>")
    ends = files.withColumn("_n", F.explode(lengths)).filter(F.length("file") >= F.col("_n"))
    return ends.select("file", F.expr("right(file, _n)").alias("source")).join(sources.distinct(), "source").select("file", "source")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, name, content) of the files of a folder; the sample's id is its path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("sample_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def sample_info(samples: DataFrame, functions: DataFrame, blocklist: Sequence[str] = BLOCKLIST) -> DataFrame:
    """(sample_id, sample_name, sample_hash, total, analysable) from ``samples(sample_id, name, content)``."""
    counts = functions.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(_analysable(blocklist)).alias("analysable"))
    infos = samples.select("sample_id", F.col("name").alias("sample_name"), F.sha2("content", 256).alias("sample_hash"))
    return infos.join(counts, "sample_id", "left").na.fill(0, ["total", "analysable"])


# fixed values: what binaries of this compiler hold
MARKERS = ("rustc", "cargo")


def has_marker(df: DataFrame, column: str, markers: Sequence[str] = MARKERS) -> DataFrame:
    """Rows with ``marked``: the text holds one of the markers."""
    return df.withColumn("marked", F.coalesce(contains_any(column, markers), F.lit(False)))


def classify_string(df: DataFrame, column: str) -> DataFrame:
    """Rows with ``string`` and ``width`` (bytes per character) of the text that the binary column begins with; null if it is none."""
    out = df.withColumn("_s", printable_string(F.col(column)))
    return out.withColumn("string", F.col("_s.text")).withColumn("width", F.col("_s.width")).drop("_s")


def report_unsupported(rows: DataFrame, tokens: Sequence[str], threshold: int = 3) -> DataFrame:
    """Rows to list: all of a function with at most ``threshold``, else those holding an interesting token; with the function's count.

    A count joined back, not a window: a function may have any number of rows.
    """
    counts = rows.groupBy(F.col(GROUP).alias("_group")).agg(F.count(F.lit(1)).alias("n_unsupported"))
    met = rows.join(counts, F.col(GROUP).eqNullSafe(F.col("_group"))).drop("_group")
    return met.filter((F.col("n_unsupported") <= threshold) | F.coalesce(contains_any("text", tokens), F.lit(False)))


def append_reports(reports: DataFrame, path: str) -> None:
    """Add rows to a report table, in its 19 columns; nothing that is there changes. What is not known of a row is null."""
    fields = schema_of("reports").fields
    unknown = set(reports.columns) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"no columns of a report: {sorted(unknown)}")
    columns = [(F.col(f.name) if f.name in reports.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    reports.select(*columns).write.mode("append").parquet(path)
