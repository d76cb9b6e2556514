"""Shared pieces of the training-data operators: table reads, tables in the shared folder, JVM-side text forms."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty. Pure ASCII text takes the byte-wise path of lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def row_key(id_col: str, text: Column) -> Column:
    """What tells rows apart whose ids are null or repeat: the id, nulls last, and a digest of the text. Never null."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), sha256(F.coalesce(text, F.lit(""))).alias("digest"))


def _matched(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    same = F.col("_row_key.none").eqNullSafe(F.col("_key_none")) & F.col("_row_key.id").eqNullSafe(F.col("_key_id")) & (F.col("_row_key.digest") == F.col("_key_digest"))
    return docs.withColumn("_row_key", key).join(keys, same, how)


def _key_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy(F.col("none").alias("_key_none"), F.col("id").alias("_key_id"), F.col("digest").alias("_key_digest")).agg(F.count("*").alias("_key_rows"))


def without_keys(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of docs whose row_key() is not among keys (none, id, digest); null ids are equal to each other."""
    return _matched(docs, key, _key_counts(keys), "left_anti").select(docs.columns)


def with_keys(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """One row of docs for each of keys (none, id, digest), which has a row for every row of docs with such a row_key(). Of
    rows that repeat a key the one whose hash of all columns is least stays; they meet combined, a row for each map task."""
    counts = Workspace(docs.sparkSession, "keys").table(_key_counts(keys), "keys")
    if counts.filter("_key_rows > 1").isEmpty():
        return _matched(docs, key, counts, "left_semi").select(docs.columns)
    once = _matched(docs, key, counts.filter("_key_rows = 1"), "left_semi").select(docs.columns)
    several = _matched(docs, key, counts.filter("_key_rows > 1"), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = several.groupBy("_row_key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return once.unionByName(least.select(docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where it is unset, as in
    local tests, a temporary folder becomes the checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="larkwing-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system, as the worker lives on, idle while the JVM beside it needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; at the end of each task its memory goes back to the system."""

    def lean(parts: Iterator) -> Iterator:
        yield from run(parts)
        give_back()

    return lean


#: Bytes of the batches that go to Python; Spark's own bound is 10,000 rows, whatever their length.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends batches of about BATCH_BYTES to Python, so neither side holds a whole partition at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_BYTES, int(before)) if before.isdigit() and int(before) > 0 else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parameter tables up to this many rows are sent to every executor; larger ones are joined like any other table.
SMALL_ROWS = 10_000


def parameter_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver values to join with, as a literal of the plan (no Python on the executors); its size is checked
    before it is broadcast."""
    text = json.dumps([dict(zip((c.split()[0] for c in schema.split(", ")), row, strict=True)) for row in rows])
    df = spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")).alias("r")).select("r.*")
    return F.broadcast(df) if len(rows) <= SMALL_ROWS else df
