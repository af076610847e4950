"""Tables in the shared folder, and the row identities that operators use.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` (read from the session); only
where that is unset and Spark runs in one process, as in tests, a folder of this machine is taken and set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    global _own
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="costlight-")
            atexit.register(shutil.rmtree, _own, True)
        where = f"file://{_own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str, within: str | None = None) -> str:
    return f"{within or shared_dir(spark) + '/costlight'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the actions inside, put back afterwards; names have __ for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table into the shared folder and reads it back; its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_by(df: DataFrame, column: str, path: str) -> None:
    """Writes a folder for each value of a column; tasks hold whole values in order, so files are written one after the other."""
    with _cleanup(df.sparkSession), settings(df.sparkSession, spark__sql__maxConcurrentOutputFileWriters="16"):
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)


class Scratch:
    """Tables of one job, dropped together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = write(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for path in self.paths:
            drop(self.spark, path)
        self.paths = []


def _cleanup(spark: SparkSession):
    """Within it, the shuffle files of an action go when it ends, not when the driver next collects its garbage."""
    return settings(spark, **{CLEANUP.replace(".", "__"): "true"})


@dataclass
class Bucketed:
    """A table of files by hash of some columns, so that joins on them leave it where it is."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    @classmethod
    def write(cls, df: DataFrame, columns: list[str], path: str, buckets: int) -> Bucketed:
        """df is partitioned by these columns into as many partitions, so each task writes one file."""
        table = cls(df.sparkSession, f"costlight_{uuid.uuid4().hex}", path, buckets)
        with _cleanup(table.spark), settings(table.spark, spark__sql__maxConcurrentOutputFileWriters="4"):
            df.write.format("parquet").bucketBy(buckets, *columns).option("path", path).option("compression", "zstd").saveAsTable(table.name)
        return table

    @classmethod
    def open(cls, spark: SparkSession, schema: str, columns: list[str], path: str, buckets: int) -> Bucketed:
        """Files of an earlier session."""
        table = cls(spark, f"costlight_{uuid.uuid4().hex}", path, buckets)
        spark.sql(f"CREATE TABLE {table.name} ({schema}) USING parquet CLUSTERED BY ({', '.join(columns)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return table

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.spark, self.path)


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


RID_IS_ID = "rid_is_id"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python in batches of at most so many rows, unless the session asks for fewer."""
    if int(spark.conf.get(BATCH_ROWS, "10000")) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def numbered(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", whole: bool = False) -> DataFrame:
    """Columns rid (long, unique), id, text and, if whole, row (a struct of all columns).

    rid is the id where ids are integers, unique and not null (the column's metadata then says so).
    Otherwise rows are numbered in the order of (id, text), null first, by a written table, so
    repeated ids and repeated rows are told apart.
    """
    base = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if whole else []))
    rest = [c for c in base.columns if c != "id"]
    if base.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        ids = base.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.max(F.col("id").isNull()).alias("null")).first()
        if (ids.most or 0) <= 1 and not ids.null:
            return base.select(F.col("id").cast("long").alias("rid", metadata={RID_IS_ID: True}), "id", *rest)
    ordered = base.orderBy(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return write(ordered.select(F.monotonically_increasing_id().alias("rid"), "id", *rest), "numbered")[0]
