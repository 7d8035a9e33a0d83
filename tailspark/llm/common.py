"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256
#: Bytes of an Arrow batch that Spark hands to a Python worker.
BATCH_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def _word_table() -> bytes:
    """Maps a UTF-8 byte to itself if it belongs to a word, A-Z to a-z, all else to a space."""
    table = bytearray(b" " * 256)
    for b in range(128, 256):
        table[b] = b
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A)):
        for b in range(lo, hi + 1):
            table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


WORD_TABLE = _word_table()
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text after lower-casing A-Z."""
    return data.translate(WORD_TABLE).split() if data else []


def utf8(column) -> Iterator[bytes | None]:
    """A string Arrow column as UTF-8 bytes, without decoding, a few hundred rows at a time."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), SLICE):
        yield from column.slice(at, SLICE).cast(kind).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names (or the session has set), shared by driver and executors.

    Only where no folder is named, as in local tests, one below the warehouse is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later reads survive the loss of an executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_folder(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def one_thread_a_task(spark: SparkSession) -> None:
    """Python workers started from now on do matrix products in the task's own thread, as all cores have tasks."""
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"


def small_batches(spark: SparkSession) -> None:
    """Python workers get batches of ``BATCH_BYTES`` from now on in this session, however long the texts, unless it has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, led by as many underscores as it takes to clash with none of ``taken``."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def lower_ascii(col):
    """Lower-cases A-Z only, as the contracts ask (``lower`` would change other letters too)."""
    return F.translate(col, UPPER, LOWER)
