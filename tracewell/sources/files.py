"""Files as tables: lines of trace files, source files of a code base, and projects with their session logs.

Three data sources list their files when a query is planned and read them in tasks. Trace files are cut at byte offsets, so one file of lines is read by many
tasks; a file that is one JSON value is read by one. Paths are local, or of any file system that Arrow opens (hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.codescan import SKIPPED

#: Bytes that a task reads of a file of lines, bytes of small files that it reads together, bytes of text in a batch, and folders of projects of a task.
SPLIT, TOGETHER, BATCH, PROJECTS = 64 << 20, 32 << 20, 4 << 20, 200
#: Folders that say nothing about a project's name.
# Fixed values.
GENERIC = ("Users", "Downloads", "home", "src", "app")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _listed(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(files.get_file_info(fs.FileSelector(folder, recursive=False)), key=lambda x: x.path)


def _reader(files: fs.FileSystem, path: str, at: int = 0) -> io.BufferedReader:
    source = files.open_input_file(path)
    source.seek(at)
    return io.BufferedReader(source, 1 << 20)


class _Batches:
    """Rows gathered into record batches of about BATCH bytes of text."""

    def __init__(self, schema: pa.Schema, text: int):
        self.schema, self.text, self.rows, self.size = schema, text, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += len(row[self.text] or "")
        if self.size >= BATCH or len(self.rows) >= 10_000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


@dataclass
class Piece(InputPartition):
    """Bytes start..end of a file."""

    path: str
    file_ord: int
    start: int
    end: int


class TraceLines(DataSource):
    """Format `trace_lines`, option path: a file, or a folder whose .json files in order of their names come first and .jsonl files next, without folders in it.
    Options suffixes (comma-separated, in their order) and split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "trace_lines"

    def schema(self) -> str:
        return "file string, file_ord long, start long, at long, line long, filled long, whole boolean, text string"

    def reader(self, schema) -> DataSourceReader:
        return _TraceLinesReader(self.options)


class _TraceLinesReader(DataSourceReader):
    SCHEMA = pa.schema([("file", pa.string()), ("file_ord", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("line", pa.int64()), ("filled", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.suffixes = options.get("suffixes", ".json,.jsonl").split(",")

    def partitions(self) -> list[Piece]:
        files, path = opened(self.path)
        found = files.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.is_file else [x for suffix in self.suffixes for x in _listed(files, path) if x.is_file and x.base_name.endswith(suffix)]
        return [Piece(x.path, i, at, min(at + self.split, x.size)) for i, x in enumerate(listed) for at in range(0, max(x.size, 1), self.split)] or [Piece("", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        files, _ = opened(self.path)
        out = _Batches(self.SCHEMA, 7)
        with _reader(files, piece.path, max(piece.start - 1, 0)) as source:
            at = piece.start
            if piece.start:  # the line that the byte before lies in belongs to the piece where it begins
                at += len(self._until(source, piece.end - piece.start + 1)) - 1
                if at >= piece.end:
                    return
            if not by_line(files, piece.path):
                if piece.start == 0:
                    yield from out.add(piece.path, piece.file_ord, 0, 0, 1, 0, True, source.read().decode("utf-8", "replace"))
                    yield from out.rest()
                return
            line = filled = 0
            while at < piece.end and (raw := source.readline()):
                line += 1
                if text := raw.decode("utf-8", "replace").strip():
                    yield from out.add(piece.path, piece.file_ord, piece.start, at, line, filled, False, text)
                    filled += 1
                at += len(raw)
            # how many lines there were, for the numbers of lines of later pieces
            yield from out.add(piece.path, piece.file_ord, piece.start, at, line, None, False, None)
        yield from out.rest()

    @staticmethod
    def _until(source: io.BufferedReader, most: int) -> bytes:
        """To the end of the line, or so many bytes."""
        return source.readline(most + 1)


def by_line(files: fs.FileSystem, path: str) -> bool:
    """Whether a file holds a value a line: its first line that is not blank is a value and another follows, or is none and not the beginning of one."""
    with _reader(files, path) as source:
        first = next((x for x in source if x.strip()), b"").decode("utf-8", "replace").strip()
        if not first:
            return False
        try:
            json.loads(first)
        except json.JSONDecodeError as bad:
            return bad.pos < len(first)
        return any(x.strip() for x in source)


@dataclass
class Some(InputPartition):
    """Files or folders of one task, with their sizes."""

    paths: list[tuple[str, int]]


def _together(found: Iterator[tuple[str, int]]) -> Iterator[Some]:
    held, size = [], 0
    for path, n in found:
        held.append((path, n))
        size += n
        if size >= TOGETHER:
            yield Some(held)
            held, size = [], 0
    if held:
        yield Some(held)


class CodeTree(DataSource):
    """Format `code_tree`, option path: the root of a code base. Folders that are skipped are not entered. Options suffixes and skipped (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "path string, inside string, size long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _CodeTreeReader(self.options)


class _CodeTreeReader(DataSourceReader):
    SCHEMA = pa.schema([("path", pa.string()), ("inside", pa.string()), ("size", pa.int64()), ("text", pa.string())])

    def __init__(self, options):
        self.root = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".py,.js,.jsx,.ts,.tsx,.mjs,.cjs").split(","))
        self.skipped = frozenset(options.get("skipped", ",".join(SKIPPED)).split(","))

    def _walk(self, files: fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
        waiting = [folder]
        while waiting:
            inner = []
            for x in _listed(files, waiting.pop()):
                if x.type == fs.FileType.Directory and x.base_name not in self.skipped and not x.base_name.endswith(".egg-info"):
                    inner.append(x.path)
                elif x.is_file and x.base_name.lower().endswith(self.suffixes):
                    yield x.path, x.size
            waiting += reversed(inner)

    def partitions(self) -> list[Some]:
        files, root = opened(self.root)
        return list(_together(self._walk(files, root))) or [Some([])]

    def read(self, some: Some) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.root)
        out = _Batches(self.SCHEMA, 3)
        for path, size in some.paths:
            with _reader(files, path) as source:
                yield from out.add(path, posixpath.relpath(path, root), size, source.read().decode("utf-8", "replace"))
        yield from out.rest()


class ProjectFolders(DataSource):
    """Format `project_folders`, option path: a folder with a folder for each project. A row for each that has session logs (option suffixes)."""

    @classmethod
    def name(cls) -> str:
        return "project_folders"

    def schema(self) -> str:
        return "folder string, raw_name string, n_sessions long, n_bytes long, said_cwd string"

    def reader(self, schema) -> DataSourceReader:
        return _ProjectFoldersReader(self.options)


class _ProjectFoldersReader(DataSourceReader):
    SCHEMA = pa.schema([("folder", pa.string()), ("raw_name", pa.string()), ("n_sessions", pa.int64()), ("n_bytes", pa.int64()), ("said_cwd", pa.string())])

    def __init__(self, options):
        self.root, self.suffixes = options["path"], tuple(options.get("suffixes", ".jsonl").split(","))

    def partitions(self) -> list[Some]:
        files, root = opened(self.root)
        if files.get_file_info(root).type != fs.FileType.Directory:
            return [Some([])]
        folders = [(x.path, 0) for x in _listed(files, root) if x.type == fs.FileType.Directory]
        return [Some(folders[i : i + PROJECTS]) for i in range(0, len(folders), PROJECTS)] or [Some([])]

    def read(self, some: Some) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.root)
        out = _Batches(self.SCHEMA, 0)
        for folder, _ in some.paths:
            logs = [x for x in _listed(files, folder) if x.is_file and x.base_name.endswith(self.suffixes)]
            if logs:
                yield from out.add(folder, posixpath.basename(folder), len(logs), sum(x.size for x in logs), self._cwd(files, logs[0].path))
        yield from out.rest()

    @staticmethod
    def _cwd(files: fs.FileSystem, path: str) -> str | None:
        """The working folder that the first session names, up to a line that cannot be read."""
        with _reader(files, path) as source:
            for raw in source:
                try:
                    entry = json.loads(raw) if raw.strip() else {}
                except ValueError:
                    return None
                if isinstance(entry, dict) and entry.get("cwd"):
                    return str(entry["cwd"])
        return None


def read(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    """The rows of one of the sources here."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def trace_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    return read(spark, TraceLines, path, **options)


def source_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, inside, size, text of the source files of a code base outside skipped folders, which `codescan` takes."""
    return read(spark, CodeTree, root, **options)


def problems(lines: DataFrame) -> DataFrame:
    """file, line_no, problem of trace_lines: `invalid` for each line that is no JSON, with its number in the file, `empty` for a file without any value.

    A piece counts its lines, so a line's number is its number in the piece and the lines of the pieces before."""
    broken = lines.where(~F.col("whole") & F.col("text").isNotNull() & F.try_parse_json("text").isNull()).select("file", "start", "line")
    pieces = lines.where(~F.col("whole") & F.col("text").isNull()).select("file", F.col("start").alias("before"), F.col("line").alias("n"))
    earlier = broken.join(pieces, (pieces["file"] == broken["file"]) & (pieces["before"] < broken["start"]), "left")
    numbered = earlier.groupBy(broken["file"], "start", "line").agg((F.col("line") + F.coalesce(F.sum("n"), F.lit(0))).alias("line_no"))
    wholes = lines.where(F.col("whole") & F.try_parse_json("text").isNull())
    each = wholes.select("file", F.posexplode(F.split("text", "\n", -1)).alias("i", "one")).where((F.trim("one") != "") & F.try_parse_json("one").isNull())
    out = numbered.select("file", "line_no", F.lit("invalid").alias("problem")).unionByName(each.select("file", (F.col("i") + 1).cast("long").alias("line_no"), F.lit("invalid").alias("problem")))
    return out.unionByName(wholes.where(~F.col("text").rlike(r"\S")).select("file", F.lit(None).cast("long").alias("line_no"), F.lit("empty").alias("problem")))


def _decoded(name: Column) -> Column:
    """The path that a project's folder is named after."""
    return F.when(name.startswith("-"), F.concat(F.lit("/"), F.translate(F.substring(name, 2, 1_000_000), "-", "/"))).otherwise(F.translate(name, "-", "/"))


def projects(spark: SparkSession, root: str, **options) -> DataFrame:
    """raw_name, display_name, cwd, prefix, n_sessions, n_bytes of each project under root; largest first is an order by n_bytes."""
    found = read(spark, ProjectFolders, root, **options)
    decoded = _decoded(F.col("raw_name"))
    last = lambda path: F.nullif(F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1), F.lit(""))
    meaningful = F.filter(F.split(decoded, "/"), lambda x: (x != "") & ~x.isin(*GENERIC) & ~x.startswith("."))
    named = F.coalesce(F.when(F.size(F.filter(F.split("said_cwd", "/"), lambda x: x != "")) > 0, last(F.col("said_cwd"))), F.when(F.size(meaningful) > 0, F.element_at(meaningful, -1)), F.col("raw_name"))
    cwd = F.coalesce("said_cwd", decoded)
    prefix = F.when(cwd.isin("", "/"), "").when(cwd.endswith("/"), cwd).otherwise(F.concat(cwd, F.lit("/")))
    return found.select("raw_name", named.alias("display_name"), cwd.alias("cwd"), prefix.alias("prefix"), "n_sessions", "n_bytes")
