"""Data sources over files too large to hold: shapefile extents, RDF finding aids, JPEG sizes; sinks that appear on commit only.

    register(spark)
    spark.read.format("shapefile_extents").load(folder)      file_id, xmin, ymin, xmax, ymax, stem
    spark.read.format("rdf_nodes").load(folder)              readers.RDF_NODE, path
    spark.read.format("rdf_edges").load(folder)              parent_id, child_id, pos, path
    spark.read.format("jpeg_sizes").load(folder)             path, width, height
    df.write.format("file_per_row").mode("append").save(folder)       name, content: a file for each row
    df.write.format("file_in_parts").mode("append").save(folder)      name, content: a file for each run of rows of one name
    df.write.format("counted_lines").mode("append").save(folder)      value: a line for each row, null ones are counted only

Files are reached by pyarrow's file systems, so a path is one of those or a local one that all executors share. Filters
on `stem` or `path` leave files unread.
"""

from __future__ import annotations

import json
import re
import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from folioworks.sources import readers

#: Rows of a batch that a source hands on, bytes of a picture's head.
BATCH, HEAD = 4096, 65536


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str, form: str) -> list[fs.FileInfo]:
    """The files of a folder (or the one file) whose name matches, in order."""
    system, at = _system(path)
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return sorted((f for f in found if f.type == fs.FileType.File and re.search(form, f.base_name)), key=lambda f: f.path)


class _FileReader(DataSourceReader):
    """A reader that leaves out files by filters on one column."""

    column = "path"

    def __init__(self, options: dict[str, str]):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == (self.column,):
                self.tests.append(f)
            yield f  # Spark applies it to the rows too

    def wanted(self, value: str) -> bool:
        test = {EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, StringStartsWith: lambda f: value.startswith(f.value)}
        return all(test[type(f)](f) for f in self.tests)


@dataclass
class _Records(InputPartition):
    stem: str
    first: int
    count: int


class _Shapes(_FileReader):
    """Parts of a shapefile by record number: the index gives each shape's place, records of the table have one width."""

    column = "stem"

    def partitions(self) -> list[_Records]:
        rows, out = int(self.options.get("rowsPerPartition", 100_000)), []
        system, _ = _system(self.options["path"])
        for f in _files(self.options["path"], r"(?i)\.shx$"):
            stem = f.path[:-4]
            if not self.wanted(f.base_name[:-4]):
                continue
            shapes = (f.size - 100) // 8
            with system.open_input_file(self._named(system, stem, "dbf")) as table:
                (records,) = struct.unpack_from("<I", table.read(32), 4)
            if records != shapes:
                raise ValueError(f"{records} records but {shapes} shapes")
            out += [_Records(stem, a, min(rows, shapes - a)) for a in range(0, shapes, rows)]
        return out or [_Records("", 0, 0)]

    @staticmethod
    def _named(system: fs.FileSystem, stem: str, kind: str) -> str:
        return next(p for p in (f"{stem}.{kind}", f"{stem}.{kind.upper()}") if system.get_file_info(p).type == fs.FileType.File)

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _system(self.options["path"])
        key, name = self.options.get("key", r"(\w+)\.\w+$"), self.options.get("name", "fichier")
        stem = partition.stem.rsplit("/", 1)[-1]
        table, index, shapes = (system.open_input_file(self._named(system, partition.stem, k)) for k in ("dbf", "shx", "shp"))
        with table, index, shapes:
            _, head, width = struct.unpack_from("<IHH", table.read(32), 4)
            names, layout = readers.dbf_layout(table.read(head - 32))
            place = names.index(name)
            for a in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - a)
                table.seek(head + a * width)
                index.seek(100 + 8 * a)
                records = layout.iter_unpack(table.read(n * width))
                offsets = struct.unpack(f">{2 * n}i", index.read(8 * n))[::2]
                rows = []
                for record, words in zip(records, offsets, strict=True):
                    shapes.seek(2 * words + 8)
                    data = shapes.read(36)
                    (kind,) = struct.unpack_from("<i", data)
                    if kind not in (0, 5):
                        raise ValueError(f"a shape of kind {kind} among polygons")
                    m = re.search(key, record[place].decode("latin-1").strip())
                    if kind == 5 and m:
                        rows.append((m.group(1), *struct.unpack_from("<4d", data, 4), stem))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.float64()) for c in columns[1:5]), pa.array(columns[5], pa.string())], ["file_id", "xmin", "ymin", "xmax", "ymax", "stem"])


class ShapefileExtents(DataSource):
    """Extents of a folder's polygons with the file id of their record; options: key (pattern of the id), name (its field), rowsPerPartition.

    Null shapes and records without an id have no row; counts of records and shapes that differ, or shapes of another kind, are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile_extents"

    def schema(self) -> str:
        return "file_id string, xmin double, ymin double, xmax double, ymax double, stem string"

    def reader(self, schema) -> DataSourceReader:
        return _Shapes(self.options)


@dataclass
class _Group(InputPartition):
    paths: list[str]


class _Grouped(_FileReader):
    """Files dealt to tasks by size."""

    form = "."

    def partitions(self) -> list[_Group]:
        most, out, held = int(self.options.get("bytesPerPartition", 32 << 20)), [[]], 0
        for f in _files(self.options["path"], self.form):
            if self.wanted(f.path):
                if out[-1] and held + self.weight(f) > most:
                    out.append([])
                    held = 0
                out[-1].append(f.path)
                held += self.weight(f)
        return [_Group(paths) for paths in out]

    def weight(self, f: fs.FileInfo) -> int:
        return f.size


#: Bytes of text that a byte of a compressed file stands for, about.
PACKED = 10


class _Rdf(_Grouped):
    form = r"(?i)\.(rdf|xml)(\.(gz|zst))?$"

    def weight(self, f: fs.FileInfo) -> int:
        return f.size * PACKED if f.extension in ("gz", "zst") else f.size

    def read(self, partition: _Group) -> Iterator[tuple]:
        system, _ = _system(self.options["path"])
        for path in partition.paths:
            with system.open_input_stream(path) as stream:  # unpacked by its name's ending
                for row in self.rows(stream):
                    yield (*row, path)

    def rows(self, stream) -> Iterator[tuple]:
        return readers.rdf_rows(stream, self.options.get("links", "true").lower() != "false")


class RdfNodes(DataSource):
    """Nodes of RDF/XML finding aids (also .gz and .zst), each file read as a stream of descriptions; options: bytesPerPartition, links (false: children and location_ids are null, so that a node of any number of children is a short row)."""

    @classmethod
    def name(cls) -> str:
        return "rdf_nodes"

    def schema(self) -> str:
        return f"{readers.RDF_NODE}, path string"

    def reader(self, schema) -> DataSourceReader:
        return _Rdf(self.options)


class _RdfLinks(_Rdf):
    def rows(self, stream) -> Iterator[tuple]:
        return readers.rdf_links(stream)


class RdfEdges(DataSource):
    """Links from nodes to their children in RDF/XML finding aids, a row for each, so a node's children are never held; option: bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "rdf_edges"

    def schema(self) -> str:
        return "parent_id string, child_id string, pos int, path string"

    def reader(self, schema) -> DataSourceReader:
        return _RdfLinks(self.options)


class _Jpeg(_Grouped):
    form = r"(?i)\.jpe?g$"

    def weight(self, f: fs.FileInfo) -> int:
        return min(f.size, HEAD)

    def read(self, partition: _Group) -> Iterator[tuple]:
        system, _ = _system(self.options["path"])
        for path in partition.paths:
            with system.open_input_file(path) as f:
                yield (path, *readers.jpeg_size(f.read(HEAD)))


class JpegSizes(DataSource):
    """Width and height of pictures, of each only the first 64 KB are read; option: bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "jpeg_sizes"

    def schema(self) -> str:
        return "path string, width int, height int"

    def reader(self, schema) -> DataSourceReader:
        return _Jpeg(self.options)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]
    counts: dict[str, int]


class _Committing(DataSourceWriter):
    """Tasks write below a staging folder; on commit their files move to their place and `_counts.json` adds up the tasks' counts. A failed job leaves no file in place; a task that outlives it may leave its staging folder, which readers pass over."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.path, self.overwrite = options, options["path"], overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        system, at = _system(self.path)
        return system, at.rstrip("/")

    def write(self, rows: Iterator) -> _Written:
        system, at = self._at()
        folder = f"{at}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        names, counts = self.put(system, folder, rows)
        return _Written(folder, names, counts)

    def put(self, system: fs.FileSystem, folder: str, rows: Iterator) -> tuple[list[str], dict[str, int]]:
        raise NotImplementedError

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = self._at()
        done = [m for m in messages if m]
        moves = [(f"{m.folder}/{name}", f"{at}/{name}") for m in done for name in m.names]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        system.create_dir(at, recursive=True)
        if self.overwrite:
            new = {to for _, to in moves}
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and f.path not in new:
                    system.delete_file(f.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: system.move(*x), moves))
        counts: dict[str, int] = {}
        for m in done:
            for k, n in m.counts.items():
                counts[k] = counts.get(k, 0) + n
        if "header" in self.options:
            with system.open_output_stream(f"{at}/header.txt") as out:
                out.write(self.options["header"].format(**counts).encode() + b"\n")
        with system.open_output_stream(f"{at}/_counts.json") as out:
            out.write(json.dumps(counts, sort_keys=True).encode())
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        for _ in range(5):  # tasks that are being ended may still write
            self._clear()
            time.sleep(0.3)

    def _clear(self) -> None:
        system, at = self._at()
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")


def _data(row) -> bytes:
    """The bytes of a row (name, content) that a file can be written from."""
    if not row.name or not re.fullmatch(r"[^/_.][^/]*", row.name) or row.content is None:
        raise ValueError(f"no file can be written for the name {row.name!r}")
    return row.content.encode() if isinstance(row.content, str) else bytes(row.content)


class _PerRow(_Committing):
    def put(self, system: fs.FileSystem, folder: str, rows: Iterator) -> tuple[list[str], dict[str, int]]:
        names, size = [], 0
        for row in rows:
            data = _data(row)
            with system.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(data)
            names.append(row.name)
            size += len(data)
        return names, {"files": len(names), "bytes": size}


class FilePerRow(DataSource):
    """Sink of rows (name, content): a file for each, all of them on commit or none; `_counts.json` has files and bytes. A name that two rows have is an error."""

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PerRow(self.options, overwrite)


class _Parts(_Committing):
    def put(self, system: fs.FileSystem, folder: str, rows: Iterator) -> tuple[list[str], dict[str, int]]:
        before, after = (self.options.get(k, "").encode() for k in ("before", "after"))
        names, size = [], 0
        for name, parts in groupby(((row.name, _data(row)) for row in rows), key=lambda x: x[0]):
            with system.open_output_stream(f"{folder}/{name}") as out:  # packed by its name's ending
                out.write(before)
                for _, data in parts:
                    out.write(data)
                    size += len(data)
                out.write(after)
            names.append(name)
            size += len(before) + len(after)
        return names, {"files": len(names), "bytes": size}


class FileInParts(DataSource):
    """Sink of rows (name, content): a file for each run of rows of one name, written a row at a time, all of them on commit or none; names that end in .gz or .zst are packed. Options: before, after (text around each file's rows). A name whose rows stand apart is an error."""

    @classmethod
    def name(cls) -> str:
        return "file_in_parts"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Parts(self.options, overwrite)


class _Lines(_Committing):
    def put(self, system: fs.FileSystem, folder: str, rows: Iterator) -> tuple[list[str], dict[str, int]]:
        name, written, without = f"part-{uuid.uuid4().hex}.txt", 0, 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                if row.value is None:
                    without += 1
                else:
                    out.write(row.value.encode() + b"\n")
                    written += 1
        return [name] if written else [], {"written": written, "without": without}


class CountedLines(DataSource):
    """Sink of rows (value): text files of a line for each; null values are not written but counted. `_counts.json` has both counts, and so has `header.txt` in the form of the option header."""

    @classmethod
    def name(cls) -> str:
        return "counted_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Lines(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sources and sinks known to a session, and lets it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ShapefileExtents, RdfNodes, RdfEdges, JpegSizes, FilePerRow, FileInParts, CountedLines):
        spark.dataSource.register(source)
