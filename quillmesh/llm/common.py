"""Helpers that several operators share."""

import re
import sys
import tempfile
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a session on this machine
    alone gets one of its own; on a cluster there is none that all executors see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmesh-"))
    return sc.getCheckpointDir()


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = 64 << 20


def small_batches(spark: SparkSession, size: int = 6 << 20) -> None:
    """Texts go to Python workers ``size`` bytes at a time, where the session leaves Spark's default:
    each task holds a batch outside the heap, twice while it grows. Results do not depend on it."""
    if spark.conf.get(BATCH).rstrip("bB") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH, str(size))


def id_bucket(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*columns):
    """96 bits that tell rows apart, as two longs; equal rows share them."""
    return [F.xxhash64(*columns).alias("k1"), F.hash(*reversed(columns)).cast("long").alias("k2")]


def fit_in_task(rows: DataFrame, learn):
    """``learn`` of all ``rows``, a sample bounded by the caller, as one Arrow table in one task of
    an executor: the driver sees the fitted model alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.schema)

    def run(batches):
        table = pa.Table.from_batches([pa.record_batch(b.columns, schema=schema) for b in batches], schema)
        yield pa.record_batch([pa.array([cloudpickle.dumps(learn(table))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return cloudpickle.loads(found[0].model) if found else learn(schema.empty_table())


def bounded_sample(rows: DataFrame, max_rows: int, max_bytes: int, salt: int) -> DataFrame:
    """rows (doc_id, text, more) to at most ``max_rows`` of them and ``max_bytes`` of text: distinct
    (doc_id, text), in order of a hash of the id, the same in every run. The bounds are applied to
    narrow rows; the texts of those that are chosen follow by a broadcast join."""
    place = ("_hash", "doc_id", "_text")
    keyed = rows.withColumns({"_hash": F.xxhash64("doc_id", F.lit(salt)), "_text": F.xxhash64("text"), "_size": F.octet_length("text").cast("long")})
    first = keyed.select(*place, "_size").distinct().orderBy(*place).limit(max_rows)
    so_far = F.sum("_size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_sum", so_far).where(F.col("_sum") <= max_bytes).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"))
    mine = keyed.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left_semi")
    return mine.dropDuplicates(["doc_id", "_text"]).select(*rows.columns)


def worker_store() -> dict:
    """A dict that lives as long as the Python worker, over all tasks that reuse it."""
    return sys.modules.setdefault("_quillmesh_worker", types.ModuleType("_quillmesh_worker")).__dict__
