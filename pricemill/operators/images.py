"""Image work lists and fetching."""

import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.functions.links import link_basename, target_path
from pricemill.schema import FETCH_SCHEMA, FETCH_TASKS, FETCH_THREADS


def image_manifest(products: DataFrame, folder: str) -> DataFrame:
    """One row per file to fetch: ``filename, url, n_urls, path``.

    Rows without a link, and links that name no file ('' and '..' are folders), are left out. Links that
    share a file name share a file: the smallest link is kept and ``n_urls`` tells how many there are.
    Links are made distinct first, so a link or a name repeated very often is small before each shuffle.
    """
    links = (
        products.select(F.col("image_link").alias("url"))
        .filter(F.col("url").isNotNull())
        .distinct()
        .withColumn("filename", link_basename("url"))
        .filter(~F.col("filename").isin("", ".."))
    )
    files = links.groupBy("filename").agg(F.min("url").alias("url"), F.count("*").alias("n_urls"))
    return files.withColumn("path", target_path(folder, "filename"))


def pending_images(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows whose file is not there yet.

    ``present`` has a ``path`` or, if all files lie in one folder, a ``filename`` column; where it also has
    ``status`` (a fetch table), only rows with status 'ok' count as present, so failed links are tried again.
    """
    if "status" in present.columns:
        present = present.filter(F.col("status") == "ok")
    key = "path" if "path" in present.columns else "filename"
    return manifest.join(present.select(key).distinct(), key, "left_anti")


class FolderStore:
    """Files in a folder that every executor reaches under the same path: one machine, or a shared mount.

    ``shared`` is the caller's word that the folder is mounted on every machine of a cluster; without it
    ``fetch_images`` refuses this store in a session that is not local.
    """

    def __init__(self, shared: bool = False):
        self.shared = shared

    @staticmethod
    def _local(path: str) -> str:
        if "://" in path or path.startswith("file:"):
            raise ValueError(f"{path} is not a plain folder: use ArrowStore")
        return path

    def size(self, path: str) -> int | None:
        """Size of a file that is already there, else None."""
        path = self._local(path)
        return os.path.getsize(path) if os.path.exists(path) else None

    def save(self, path: str, content: bytes) -> None:
        """Write under a temporary name, then rename: a file under its final name is whole."""
        folder, name = os.path.split(self._local(path))
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
        try:
            with open(part, "wb") as out:
                out.write(content)
            os.replace(part, path)
        except BaseException:
            if os.path.exists(part):
                os.unlink(part)
            raise


class ArrowStore:
    """Files of a file system that paths name by a scheme (hdfs, s3, gs, file), through pyarrow."""

    @staticmethod
    def _open(path: str):
        """File system and path in it. Only the folder is a URI: a file name may hold '?', '#', '%' and blanks."""
        from pyarrow import fs

        folder, _, name = path.rpartition("/")
        system, plain = fs.FileSystem.from_uri(f"{folder}/")
        return system, f"{plain.rstrip('/')}/{name}"

    def size(self, path: str) -> int | None:
        from pyarrow import fs

        system, plain = self._open(path)
        info = system.get_file_info(plain)
        return info.size if info.type == fs.FileType.File else None

    def save(self, path: str, content: bytes) -> None:
        system, plain = self._open(path)
        folder, _, name = plain.rpartition("/")
        system.create_dir(folder, recursive=True)
        part = f"{folder}/.{uuid.uuid4().hex}.part"
        try:
            with system.open_output_stream(part) as out:
                out.write(content)
            system.move(part, plain)
        except BaseException:
            if self.size(f"{path[: path.rindex('/')]}/{part.rpartition('/')[2]}") is not None:
                system.delete_file(part)
            raise


def store_for(folder: str, shared: bool = False):
    """The store for a folder: ``ArrowStore`` if it has a scheme, else ``FolderStore``, which may be ``shared``."""
    return ArrowStore() if "://" in folder else FolderStore(shared)


def fetch_images(
    pending: DataFrame,
    fetcher: Callable[[str], bytes],
    store=None,
    n_tasks: int = FETCH_TASKS,
    threads: int = FETCH_THREADS,
) -> DataFrame:
    """Fetch every pending link; returns ``filename, url, path, status, n_bytes, error`` per file.

    ``fetcher(url)`` returns the bytes or raises. A failed link becomes a row with status 'error' and
    does not stop the others. A file that is there already is not fetched again, so a repeated task does
    no harm. Like every Spark table the result is lazy: write it once and read the written table.

    Each task waits for up to ``threads`` links at a time, so running tasks times ``threads`` links are
    open at once; use ``threads=1`` for a fetcher that is not thread-safe.
    """
    store = store or FolderStore()
    master = pending.sparkSession.conf.get("spark.master", "")
    if isinstance(store, FolderStore) and not (store.shared or master.startswith("local")):
        raise ValueError("executors of a cluster have folders of their own: use ArrowStore or FolderStore(shared=True)")

    def fetch_one(url, path):
        try:
            size = store.size(path)
            if size is None:
                content = fetcher(url)
                store.save(path, content)
                size = len(content)
            return "ok", size, None
        except Exception as error:
            return "error", None, f"{type(error).__name__}: {error}"

    def fetch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                results = list(pool.map(fetch_one, batch["url"], batch["path"]))
                outcome = pd.DataFrame(results, columns=["status", "n_bytes", "error"])
                outcome["n_bytes"] = outcome["n_bytes"].astype("Int64")
                outcome.insert(0, "filename", batch["filename"].to_numpy())
                outcome.insert(1, "url", batch["url"].to_numpy())
                outcome.insert(2, "path", batch["path"].to_numpy())
                yield outcome

    work = pending.select("filename", "url", "path").repartition(n_tasks, "filename")
    return work.mapInPandas(fetch_batches, FETCH_SCHEMA)
