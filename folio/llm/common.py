"""What the corpus operators share: the cluster's scratch folder, written cuts in lineage, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import ship

#: Rows of one Arrow batch; documents may be long, and a batch is held as a whole.
BATCH_ROWS = 500
#: Scratch paths by application, for ``clear_scratch``.
_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where it is unset and all runs on one machine, as in tests, a temporary folder is made and set;
    on a cluster that is an error, for executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete this application's scratch tables below the shared folder, and say how many.

    Tables live as long as results that read them may be used; call this when they no longer are.
    """
    jvm = spark.sparkContext._jvm
    gone = 0
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: it is computed once, and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send the code to the executors, and lower the rows of an Arrow batch unless the session asks for fewer.

    The setting stays for the session: plans are made when a result is used, which may be long after
    the operator has returned it. Spark itself bounds a batch's bytes (``arrow.maxBytesPerBatch``, 64 MB).
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_vector(parts: DataFrame, size: int, dtype: str) -> np.ndarray:
    """The sum of the vectors in ``parts`` (lot int, v binary of zlib), added up by lots and then in all.

    A lot is a random number below 256, so that no task and not the driver gathers all partitions'.
    """

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype)
        for v in table.column("v"):
            total += np.frombuffer(zlib.decompress(v.as_py()), dtype)
        return pa.table({"lot": pa.array([0], pa.int32()), "v": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    row = parts.groupBy("lot").applyInArrow(add, "lot int, v binary").groupBy(F.lit(0).alias("one")).applyInArrow(add, "lot int, v binary").first()
    return np.frombuffer(zlib.decompress(row["v"]), dtype).copy() if row else np.zeros(size, dtype)


def vector_part(total: np.ndarray) -> pa.RecordBatch:
    """One partition's vector, as ``total_vector`` takes it."""
    lot = int(np.random.default_rng().integers(256))
    return pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["lot", "v"])


def id_fold(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A 64-bit key of id and text: rows have one key only if they are equal in both."""
    return F.xxhash64(id_col, text_col)


#: Bytes of a table of ids (16 each) up to which it is broadcast to the documents it takes away.
BROADCAST_BYTES = 8 << 20


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in the only column of ``gone``; a null id there takes all null ids away.

    The ids are counted first: a table within BROADCAST_BYTES goes to every task and no text is
    shuffled, a larger one is joined by a shuffle.
    """
    ids = written(gone.toDF("__gone").distinct(), "gone")
    side = F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids
    return docs.join(side, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
