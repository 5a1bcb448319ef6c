"""Cutting lineage: intermediate tables in the cluster's shared folder.

Iterative jobs must not drag an ever longer plan along, and must not lose their state with an executor. Every round is therefore
written as a Parquet table under the folder named by ``spark.checkpoint.dir`` and read back. Unlike an RDD checkpoint the written
table brings real sizes to the optimizer, so a small frontier is broadcast by Spark's own size check and a large one is not.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
#: Spark takes a file's size for its table's. Dictionaries and runs of nulls make stored rounds some 30 times smaller than their rows are in
#: memory, so that tables of hundreds of megabytes were sent through the driver. This corrects what is broadcast without being measured.
FACTOR, PACKED = "spark.sql.sources.fileCompressionFactor", "32"
SUBSET, SENT = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold"
#: Rows are dealt out by this column.
DEALT_BY = "func_id"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; in local mode a fresh temporary folder is named where none is set."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tributary-")
    spark.conf.set(SETTING, folder)
    return folder


def real_sizes(spark: SparkSession) -> None:
    """Have Spark reckon with unpacked rows when it decides what to broadcast; a session's own setting stays."""
    if float(spark.conf.get(FACTOR, "1.0")) == 1.0:
        spark.conf.set(FACTOR, PACKED)


@contextmanager
def _as_dealt(spark: SparkSession):
    """Joins inside take rows that are dealt out by some of their keys as they lie, and send nothing through the driver."""
    before = spark.conf.get(SUBSET, "true"), spark.conf.get(SENT)
    spark.conf.set(SUBSET, "false")
    spark.conf.set(SENT, "-1")
    try:
        yield
    finally:
        spark.conf.set(SUBSET, before[0])
        spark.conf.set(SENT, before[1])


def cut(df: DataFrame, where: Column | None = None, dealt: int = 0) -> tuple[DataFrame, int, str]:
    """Write ``df`` once; give the stored table, its row count (of rows ``where``) and its path.

    The count comes with the write. Metrics may get lost on their way; then the stored rows are counted, as loops end by this number.
    ``dealt``: store the rows in so many buckets by group. Joins and groupings of such tables by group and more need no shuffle.
    """
    spark = df.sparkSession
    if dealt:
        return _insert(df, where, dealt, _bucketed(spark, df.schema, dealt))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n")).write.parquet(path)
    table = stored(spark, df.schema, [path])
    table._path = path
    n = seen.get.get("n")
    if n is None:
        n = (table if where is None else table.filter(where)).count()
    return table, n, path


def _bucketed(spark: SparkSession, schema, n: int) -> str:
    """The name of a new table in ``n`` buckets by group; its files lie in the shared folder."""
    name = f"tributary_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{DEALT_BY}`) INTO {n} BUCKETS LOCATION '{shared_folder(spark)}/{name}'")
    return name


def _insert(df: DataFrame, where: Column | None, n: int, name: str) -> tuple[DataFrame, int, str]:
    """As ``cut``, into a bucketed table."""
    spark, seen = df.sparkSession, Observation()
    count = (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n")
    with _as_dealt(spark):
        df.repartition(n, DEALT_BY).observe(seen, count).write.insertInto(name)
    table = spark.table(name)
    table._path, table._name, table._dealt = f"{shared_folder(spark)}/{name}", name, n
    rows = seen.get.get("n")
    if rows is None:
        rows = (table if where is None else table.filter(where)).count()
    return table, rows, table._path


class Rounds:
    """Rounds of rows that are stored one after the other and read as one table; in ``dealt`` buckets by group, if any."""

    def __init__(self, dealt: int = 0):
        self.dealt, self.n, self.paths, self.name = dealt, 0, [], None

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Store a round; give it back with its row count."""
        self.n += 1
        if not self.dealt:
            table, rows, path = cut(df)
            self.spark, self.schema = df.sparkSession, table.schema
            self.paths.append(path)
            return table, rows
        df = df.withColumn("_round", F.lit(self.n))
        if self.name is None:
            self.spark, self.schema = df.sparkSession, df.schema
            self.name = _bucketed(self.spark, self.schema, self.dealt)
        df = df.select(*[F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in self.schema.fields])
        self.table, rows, _ = _insert(df, F.col("_round") == self.n, self.dealt, self.name)
        return self.table.filter(F.col("_round") == self.n).drop("_round"), rows

    def all(self) -> DataFrame:
        if not self.dealt:
            return stored(self.spark, self.schema, self.paths)
        out = self.table.drop("_round")
        out._dealt = self.dealt
        return out


def stored(spark: SparkSession, schema, paths: list[str]) -> DataFrame:
    """Several stored rounds as one table."""
    return spark.read.schema(schema).parquet(*paths)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` or ``keep`` that nothing reads any more; what was derived from them must be stored before."""
    for table in tables:
        path = getattr(table, "_path", None)
        if path:
            spark = table.sparkSession
            if getattr(table, "_name", None):
                spark.sql(f"DROP TABLE IF EXISTS {table._name}")
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, which lets executors delete the shuffles of plans that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def keep(df: DataFrame, dealt: int = 0) -> DataFrame:
    """``cut`` for callers that only want the table."""
    return cut(df, dealt=dealt)[0]


def settled(df: DataFrame | None, dealt: int) -> DataFrame | None:
    """``df`` in buckets, where its graph is: several rounds read it without a shuffle each."""
    return keep(df, dealt) if dealt and df is not None and getattr(df, "_dealt", 0) != dealt else df
