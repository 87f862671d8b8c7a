"""Tables written once to the shared folder, so that later jobs read settled rows."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_job_folder: ContextVar[str | None] = ContextVar("job_folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; for a local session without it a temporary one, which
    goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="pricemill-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    folder = _job_folder.get() or f"{shared_folder(spark)}/pricemill"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path for files that Spark does not write: a plain folder, or a URI with its file system.

    A path without a scheme lies in Spark's default file system, which need not be the machine's.
    """
    folder = new_path(spark, name)
    if "://" not in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return folder if "://" in folder else folder.removeprefix("file:")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return the table read back.

    Values fixed at write time (partition ids, random or fetched values) stay the same for every later
    job, also after lost executors. Like checkpoints, the tables stay until someone removes them, unless
    they are made inside ``released_after``.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_in(folder: str) -> Iterator[None]:
    """Put the tables staged inside the block into this folder, to be removed by ``remove``."""
    token = _job_folder.set(folder)
    try:
        yield
    finally:
        _job_folder.reset(token)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released_after(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block at its end, for jobs that write their own output."""
    folder = new_path(spark, "job")
    try:
        with staged_in(folder):
            yield
    finally:
        remove(spark, folder)
