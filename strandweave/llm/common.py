"""What the operators of this subpackage share: tables in the cluster's shared folder, and reading of columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: fixed by the queries' contract.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests on one machine), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strandweave/{name}-{uuid.uuid4().hex}"


_RECORDS: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]):
    """Tables stored meanwhile are noted in `paths`, so that whoever asks for it can delete them, and no others."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.pop()


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    if _RECORDS and not keep:
        _RECORDS[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables: what was made of them must have been written by now."""
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types: other columns, whatever their names, play no part."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()))


def packed(df: DataFrame) -> DataFrame:
    """Whole rows in one column `row`: what is put beside it can clash with no name of theirs."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def text_bytes(batch) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)


def slices(batches, most: int, size=text_bytes):
    """The rows of Arrow batches, so many at a time that their sizes add up to about `most`: it bounds memory alone."""
    for b in batches:
        after, at = np.cumsum(size(b)), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
    give_back()


_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What tasks of one operator keep for the next ones in this Python worker; what other operators kept goes."""
    for other in [k for k in _CACHES if k != owner]:
        del _CACHES[other]
    return _CACHES.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the machine: a Python worker is used again by later stages, which may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
