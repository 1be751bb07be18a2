"""What the operators share: the folder all executors see, written intermediate tables, bounded label samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tune(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that very long texts don't fill a Python worker; a value that the caller has set stays.

    Plans read the setting when they run, which is after this returns, so it stays for the session.
    """
    if spark.conf.get(BATCH) == "10000":  # the default
        spark.conf.set(BATCH, "500")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="starloom-")
    return _LOCAL[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/starloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if partition_by is None else spark.read.parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A key is hot if it has more than one in HOT of all rows: there are fewer than HOT such keys, so their table can be broadcast.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with table (keys, n: rows of the key in `rows`, ...) by keys: hot keys where their rows lie, the others dealt out.

    No task gathers a hot key's rows. how is inner or left; keys are not null; n is dropped.
    """
    hot = table.where(F.col("n") * HOT > total).drop("n")
    apart = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col("n") * HOT <= total).drop("n"), keys, how)
    return apart.unionByName(rest)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int, where=None) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `rows` labelled documents and `max_bytes` bytes of text, in order of a hash of the id.

    Null labels are left out; where an id is labelled more than once the largest label counts. `where` restricts the ids.
    Both bounds are fixed parameters, so what reaches the driver doesn't grow with the corpus.
    """
    ids = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    wanted = [(int(r[0]), int(r[1])) for r in ids.collect()]
    if not wanted:
        return []
    spark = docs.sparkSession
    rank = {d: k for k, (d, _) in enumerate(wanted)}
    pick = F.broadcast(spark.createDataFrame(wanted, "doc_id long, y int"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = base.join(pick, "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text") + 64).alias("b")).collect()
    keep, total = [], 0
    for d, b in sorted(sizes, key=lambda r: rank[r[0]]):
        if total + b <= max_bytes:
            total += b
            keep.append((d, wanted[rank[d]][1]))
    if not keep:
        return []
    pick = F.broadcast(spark.createDataFrame(keep, "doc_id long, y int"))
    got = base.join(pick, "doc_id").select("doc_id", "text", "y").collect()
    return sorted(((int(r[0]), r[1], int(r[2])) for r in got), key=lambda r: (rank[r[0]], r[1]))


def release() -> None:
    """Memory that Python has freed goes back to the system, as the driver's JVM grows beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
