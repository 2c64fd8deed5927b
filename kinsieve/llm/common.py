"""What the text operators share: shared-folder tables, Arrow text access, word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own if they are one process, as in tests; RuntimeError on a cluster."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="kinsieve-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return f"file://{_OWN_DIRS[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinsieve/{name}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of tables materialized inside the block."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized tables that no later plan reads."""
    for p in paths:
        with contextlib.suppress(Exception):  # the session may have ended
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_tiles(rows: DataFrame, key: list[str], by: str, most: int, name: str) -> DataFrame:
    """``rows`` with ``tile``, ``ti`` and ``tj``: a key of over ``most`` rows is cut into tiles by a hash of ``by``, and a row goes to each pair of tiles
    that its own is in; other keys have one tile. Every two rows of a key meet in one pair of tiles at least."""
    large = rows.groupBy(*key).count().where(F.col("count") > most).select(*key, F.ceil(F.col("count") / most).cast("bigint").alias("tiles"))
    large = materialize(large, f"{name}-large")  # of known size, so that a small table is sent to all tasks and a large one is not
    dealt = rows.join(large, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(by), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    return dealt.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")}).drop("other", "tiles")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(col, n: int):
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def py_fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def byte_values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array without copying; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string_view(array.type) or pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    if array.null_count:
        array = array.fill_null(b"" if "binary" in str(array.type) else "")
    n = len(array)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, n + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[at[0] : at[-1]], at - at[0]


def byte_slices(array: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about ``most`` bytes, so that a batch of long texts needs bounded memory."""
    values, at = byte_values(array)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, values[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
