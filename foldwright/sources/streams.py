"""Bytes of files, read in the tasks in bounded chunks from the shared file system.

The binary file source holds a whole file in one cell.  Here Spark lists the files and deals them to tasks; a task opens
each of its files and reads no more at once than a chunk, so a file may have any size, or reads its first bytes alone.
"""

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 8 << 20


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path as Spark tells it (``file:/...``, another scheme, or none)."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def dealt(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Files dealt to tasks one by one, so that one long file leaves the others to other tasks."""
    spark = files.sparkSession
    return files.repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "path")


def digests(files: DataFrame, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """``path, size_bytes, sha256, md5, largest_read`` of each file of ``files`` (``path``); a file that cannot be read fails the query."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                sha, md5, size, most = hashlib.sha256(), hashlib.md5(), 0, 0
                system, place = _file_system(path)
                with system.open_input_stream(place) as source:
                    while data := source.read(chunk):
                        sha.update(data)
                        md5.update(data)
                        size, most = size + len(data), max(most, len(data))
                yield pd.DataFrame({"path": [path], "size_bytes": [size], "sha256": [sha.hexdigest().upper()], "md5": [md5.hexdigest()], "largest_read": [most]})

    return dealt(files.select("path"), tasks).mapInPandas(work, "path string, size_bytes long, sha256 string, md5 string, largest_read long")


def first_bytes(files: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """``path, content``: the first ``n`` bytes of each file (all of a shorter one), by one read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for path in batch["path"]:
                system, place = _file_system(path)
                with system.open_input_file(place) as source:
                    heads.append(source.read_at(min(n, source.size()), 0))
            yield pd.DataFrame({"path": batch["path"], "content": heads})

    return dealt(files.select("path"), tasks).mapInPandas(work, "path string, content binary")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write each ``content`` (binary) to ``folder/name`` and give ``path, size_bytes``; a task that is run again writes the same file again."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                system, place = _file_system(f"{folder}/{name}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"path": folder + "/" + batch["name"], "size_bytes": batch["content"].map(len).astype("int64")})

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(work, "path string, size_bytes long")
