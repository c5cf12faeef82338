"""Array files as tables: ``.npz`` bundles of named arrays and ``.npy`` files, read by byte range and written atomically.

A bundle's arrays have a row for each row of the table: one-dimensional arrays are scalar columns, two-dimensional ones are
array columns. A reader takes the shapes from the files' headers, cuts the rows into ranges, and a task reads only its own
range's bytes of the columns asked for, seeking to them; members that are compressed are read from their start.

A writer's tasks put their shards beside the table under names that nobody reads. The commit moves them to their
names and then replaces the table's manifest in one step: readers see the old shards or the new ones, never a part.

Options: ``path``; ``rows`` (of a range or shard), ``columns`` (comma-separated members; all otherwise), ``start`` and ``stop`` (rows of the whole table),
``place`` (the name of a further column: a row's place in the whole table).
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows of a range or a shard.
ROWS = 65_536
MANIFEST = "manifest.json"
_KINDS = {"i8": T.LongType(), "i4": T.IntegerType(), "i2": T.ShortType(), "i1": T.ByteType(), "f8": T.DoubleType(), "f4": T.FloatType(), "b1": T.BooleanType()}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Member:
    """Where an array's data begin in a file (-1 if it is compressed), and what it is."""

    name: str
    at: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def row_bytes(self) -> int:
        return int(np.dtype(self.dtype).itemsize * np.prod(self.shape[1:], dtype=np.int64))


def _header(file) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(file)
    if fortran and len(shape) > 1 or len(shape) not in (1, 2) or dtype.str[1:] not in _KINDS or dtype.byteorder == ">":
        raise ValueError(f"an array of shape {shape} and type {dtype.str} is no column")
    return shape, dtype


def members(file, name: str) -> list[Member]:
    """The arrays of a file, from headers alone."""
    if name.endswith(".npy"):
        shape, dtype = _header(file)
        return [Member("values", file.tell(), shape, dtype.str)]
    out = []
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset + 26)
                n, extra = np.frombuffer(file.read(4), "<u2")
                file.seek(info.header_offset + 30 + int(n) + int(extra))
                shape, dtype = _header(file)
                at = file.tell()
            else:
                with z.open(info) as part:
                    shape, dtype = _header(part)
                at = -1
            out.append(Member(info.filename.removesuffix(".npy"), at, shape, dtype.str))
    if len({m.shape[0] for m in out}) > 1:
        raise ValueError(f"the arrays of {name} differ in length")
    return out


def rows_of(file, member: Member, start: int, stop: int) -> np.ndarray:
    """The rows from ``start`` to ``stop``; of a stored array only their bytes are read."""
    shape = (stop - start, *member.shape[1:])
    if member.at >= 0:
        file.seek(member.at + start * member.row_bytes)
        data = file.read((stop - start) * member.row_bytes)
    else:
        with zipfile.ZipFile(file) as z, z.open(f"{member.name}.npy") as part:
            _header(part)
            part.seek(part.tell() + start * member.row_bytes)
            data = part.read((stop - start) * member.row_bytes)
    return np.frombuffer(data, member.dtype).reshape(shape)


def column(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel())
    if values.ndim == 1:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    members: list[Member]
    before: int


def manifest(path: str) -> dict | None:
    store, root = open_fs(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def shards(path: str) -> list[str]:
    """The files of a table: those of its manifest, else all array files of a folder, else the file itself."""
    store, root = open_fs(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return [root]
    if (known := manifest(path)) is not None:
        return [f"{root}/{s['name']}" for s in known["shards"]]
    found = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith((".npy", ".npz")))
    if not found:
        raise ValueError(f"no array files at {path}")
    return found


def _members_of(path: str, shard: str) -> list[Member]:
    with open_fs(path)[0].open_input_file(shard) as f:
        return members(f, shard)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.start, self.stop, self.place = int(options.get("start", 0)), options.get("stop"), options.get("place")
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for shard in shards(self.path):
            found = _members_of(self.path, shard)
            n = found[0].shape[0] if found else 0
            own = [m for m in found if self.columns is None or m.name in self.columns]
            if self.columns:
                own.sort(key=lambda m: self.columns.index(m.name))
            first, last = max(self.start - before, 0), n if self.stop is None else min(n, int(self.stop) - before)
            out += [Range(shard, a, min(a + self.rows, last), own, before) for a in range(first, last, self.rows)]
            before += n
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no rows at all
            return
        store = open_fs(self.path)[0]
        with store.open_input_file(partition.path) as f:
            columns = [column(rows_of(f, m, partition.start, partition.stop)) for m in partition.members]
        names = [m.name for m in partition.members]
        if self.place:
            columns.append(pa.array(np.arange(partition.start, partition.stop) + partition.before))
            names.append(self.place)
        yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite
        self.names, self.run, self.kind = schema.fieldNames(), uuid.uuid4().hex, json.loads(schema.json())

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        self.task, done, held, n = task.partitionId(), [], [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, self.rows - n)
                held.append(part)
                n, batch = n + len(part), batch.slice(len(part))
                if n == self.rows:
                    done.append(self.shard(held, len(done)))
                    held, n = [], 0
        if n:
            done.append(self.shard(held, len(done)))
        return Written(done)

    def shard(self, held: Sequence[pa.RecordBatch], k: int) -> dict:
        table = pa.Table.from_batches(held)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name in self.names:
                with z.open(zipfile.ZipInfo(f"{name}.npy"), "w", force_zip64=True) as part:
                    np.lib.format.write_array(part, matrix(name, table.column(name).combine_chunks()), allow_pickle=False)
        data = out.getvalue()
        # An attempt that is lost leaves a file of its own, which no manifest names.
        temporary = f"_{self.run}-{self.task:06d}-{k:04d}-{uuid.uuid4().hex}"
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{temporary}") as f:
            f.write(data)
        return {"name": f"part-{self.task:06d}-{k:04d}-{self.run}.npz", "temporary": temporary, "rows": table.num_rows, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        before = [] if self.overwrite else (manifest(self.path) or {"shards": []})["shards"]
        new = [s for m in messages if m for s in m.shards]
        for s in new:
            store.move(f"{root}/{s['temporary']}", f"{root}/{s['name']}")
        keep = [{k: v for k, v in s.items() if k != "temporary"} for s in [*before, *sorted(new, key=lambda s: s["name"])]]
        with store.open_output_stream(f"{root}/_{self.run}.json") as f:
            f.write(json.dumps({"schema": self.kind, "shards": keep}, sort_keys=True).encode())
        store.move(f"{root}/_{self.run}.json", f"{root}/{MANIFEST}")
        self._clean(store, root, {s["name"] for s in keep})

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_fs(self.path)
        self._clean(store, root, {s["name"] for s in (manifest(self.path) or {"shards": []})["shards"]})

    def _clean(self, store: fs.FileSystem, root: str, keep: set[str]) -> None:
        """Delete what this run's attempts left, and shards that the manifest no longer names."""
        for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"_{self.run}") or (i.base_name.startswith("part-") and i.base_name not in keep):
                store.delete_file(i.path)


def matrix(name: str, values: pa.Array) -> np.ndarray:
    """A column as an array; every row must be there, and array rows must be of one length."""
    if values.null_count or (pa.types.is_list(values.type) and values.flatten().null_count):
        raise ValueError(f"{name} holds nulls, which array files can't")
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False)
    lengths = values.value_lengths().to_numpy()
    if len(set(lengths.tolist())) > 1:
        raise ValueError(f"{name} holds arrays of different lengths")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        found = shards(path)
        if found:
            kind = lambda m: _KINDS[m.dtype[1:]] if len(m.shape) == 1 else T.ArrayType(_KINDS[m.dtype[1:]], False)
            fields = {m.name: T.StructField(m.name, kind(m)) for m in _members_of(path, found[0])}
        else:  # a table without rows
            fields = {f.name: f for f in T.StructType.fromJson(manifest(path)["schema"])}
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(fields)
        place = self.options.get("place")
        return T.StructType([*(fields[n] for n in names), *([T.StructField(place, T.LongType())] if place else [])])

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("arrays")`` and ``df.write.format("arrays")`` known to the session."""
    spark.dataSource.register(Arrays)
