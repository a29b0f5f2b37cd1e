"""Helpers that the corpus operators share: where tables are cut, ids, and slices of Arrow batches."""

from __future__ import annotations

import atexit
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts words: what ASCII white space separates.
WORD_BREAK = r"[\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a folder of this machine."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault("path", "file://" + tempfile.mkdtemp(prefix="tracewell-"))


def own_place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of the file system that Spark finds it in, so that Python reads it there too. All paths of an application
    lie in one folder, which goes when its driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tracewell-{spark.sparkContext.applicationId}")
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if folder not in _own_folder.values():
        _own_folder[folder] = folder
        atexit.register(_remove, spark, folder, os.getpid())
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str, owner: int | None = None) -> None:
    """Removes a path of the shared folder; does nothing in a process that only descends from the driver, or once the session is stopped."""
    if spark.sparkContext._jsc is None or owner not in (None, os.getpid()):
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back: later steps do not repeat its work."""
    path = own_place(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.__dict__["_cut_at"] = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes what `cut` wrote for these tables, once nothing that is still to run reads them."""
    for t in tables:
        if path := t.__dict__.get("_cut_at"):
            _remove(t.sparkSession, path)


@dataclass
class Files:
    """Files by name in a folder that driver and executors share. At most `most` of them are open at a time in a process: mapped where the folder has
    a local path, else read into memory."""

    uri: str
    most: int = 512
    opened: OrderedDict = field(default_factory=OrderedDict)

    def __getstate__(self):
        return {"uri": self.uri, "most": self.most, "opened": OrderedDict()}

    def _local(self) -> str | None:
        parsed = urlparse(self.uri)
        return parsed.path if parsed.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.uri)

    def write(self, name: str, parts: Iterable) -> None:
        """Buffers one after the other; whole or not at all, so a task that runs twice does no harm."""
        part = f".{name}.{uuid.uuid4().hex}"
        if folder := self._local():
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{part}", "wb") as out:
                for p in parts:
                    out.write(p)
            os.replace(f"{folder}/{part}", f"{folder}/{name}")
            return
        files, folder = self._remote()
        files.create_dir(folder)
        with files.open_output_stream(f"{folder}/{part}") as out:
            for p in parts:
                out.write(p)
        files.move(f"{folder}/{part}", f"{folder}/{name}")

    def read(self, name: str) -> memoryview | None:
        """The bytes of a file; None if there is no such file."""
        if name in self.opened:
            self.opened.move_to_end(name)
            return self.opened[name]
        if folder := self._local():
            try:
                with open(f"{folder}/{name}", "rb") as source:
                    found = memoryview(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)) if os.fstat(source.fileno()).st_size else memoryview(b"")
            except FileNotFoundError:
                found = None
        else:
            files, folder = self._remote()
            found = memoryview(files.open_input_file(f"{folder}/{name}").read()) if files.get_file_info(f"{folder}/{name}").is_file else None
        self.opened[name] = found
        while len(self.opened) > (self.most if self._local() else max(1, self.most // 64)):
            self.opened.popitem(last=False)
        return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, which every machine has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(id_column: Column, parts: int, part: int) -> Column:
    """True for ids whose crc32 as text leaves the remainder; false for null ids, which therefore count as training rows."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))


def of_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total + size > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))
