"""Shared pieces of the training-data operators: the shared work folder, and tables written there."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more characters that are no ASCII white space (Java and Python regular expressions).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that Python functions work on at once, where more would only take memory.
SLICE = 512

_own: dict[str, str] = {}
_keeper: list[tuple[str, Callable[[], None]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/sightloom"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sightloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stashes:
    """Tables of an iteration: each goes when the rounds that read it are over."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag, self.paths = spark, tag, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """The rows of df, written; what had this name before goes, so df may have read it."""
        path = new_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        if name in self.paths:
            drop_path(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.paths):
            drop_path(self.spark, self.paths.pop(name))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def take_over(owner: str, release: Callable[[], None]) -> None:
    """Called in a Python worker where an operator begins: what another operator keeps there is released.

    Spark hands its workers from task to task, so that the caches of a pipeline's operators would add up in them.
    """
    if _keeper and _keeper[0][0] != owner:
        _keeper.pop()[1]()
        give_back()
    if not _keeper:
        _keeper.append((owner, release))


def give_back() -> None:
    """Returns free memory to the system: allocators keep it, and a worker lives on."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(values: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """The values in order, SLICE at once."""
    for k in range(0, len(values), SLICE):
        yield values.slice(k, SLICE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
