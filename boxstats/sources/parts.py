"""Particle files written as numbered parts, by Spark's Python data source writer.

The table is numbered once, so every part knows its rows before it is written. Its batches are encoded where
they lie, as bytes of the sections of their part; Spark brings the bytes of a part together and sorts them, and
a task passes them on to a file below a temporary folder beside the target, holding some of them at a time. When all
tasks are done, the driver moves the files to their names. A task that fails leaves nothing, and a task that runs
twice is moved once. The path may be local or any URI of a file system that Arrow knows.

One part has the name itself; more of them have their number in it: ``snap.0``, ``x.0.h5``.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from boxstats.storage import materialize

#: Rows of a part, which one task sorts as encoded bytes (28 a particle).
ROWS_PER_FILE = 1 << 22
#: Rows of a task where files are smaller than that.
ROWS_PER_TASK = 1 << 18
#: Files that the driver opens or moves at a time; each waits for its file system.
FILES_AT_ONCE = 32
_FILE, _NUMBER = "_file", "_number"
#: The section that comes before all others: row counts of encoded rows, as 64-bit integers.
_COUNTS = -1
_SECTION, _DATA = "_section", "_data"
_SUFFIXES = (".h5", ".b")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a local path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[len("file:") :]
    return fs.LocalFileSystem(), os.path.abspath(path)


def _stem(path: str) -> tuple[str, str]:
    for suffix in _SUFFIXES:
        if path.endswith(suffix):
            return path[: -len(suffix)], suffix
    return path, ""


def part_name(path: str, k: int, files: int) -> str:
    stem, suffix = _stem(path)
    return path if files == 1 else f"{stem}.{k}{suffix}"


def part_files(path: str) -> list[str]:
    """The file itself, or its numbered parts in order; the name as it is where there are neither."""
    system, inner = filesystem(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        return [path]
    stem, suffix = _stem(inner)
    folder, name = os.path.split(stem)
    known = re.compile(re.escape(name) + r"\.(\d+)" + re.escape(suffix))
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    numbers = sorted(int(m[1]) for f in found if (m := known.fullmatch(f.base_name)))
    return [part_name(path, k, 2) for k in numbers] or [path]


def at_once(work: Callable, items: list) -> list:
    """``work`` of every item, in order, several at a time."""
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        return list(pool.map(work, items))


class PartsWritten(WriterCommitMessage):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


@dataclass(frozen=True)
class Layout:
    """How the rows of a part become its file.

    ``encode`` gives the row counts that a frame needs (one, or one of every kind of rows) and (section, bytes) of
    consecutive rows. ``frame`` makes from the counts of a whole part its file: bytes as they are, and
    numbers of sections, ascending, for all bytes of that section in the order of rows.
    """

    encode: Callable[[pa.RecordBatch], tuple[list[int], list[tuple[int, bytes]]]]
    frame: Callable[[list[int]], list[bytes | int]]


def packed(rows: pa.RecordBatch, fields: list[tuple[str, str]]) -> bytes:
    """One record of ``fields`` (column, numpy format) for every row."""
    records = np.empty(rows.num_rows, np.dtype(fields))
    for column, _ in fields:
        records[column] = rows.column(column).to_numpy(zero_copy_only=False)
    return records.tobytes()


class _Frame:
    """Writes the sections of one file, which come in order, and what stands between them."""

    def __init__(self, out, frame: Callable[[list[int]], list[bytes | int]] | None):
        self.out, self.frame, self.counts, self.left = out, frame, 0, None

    def add(self, section: int, data: pa.Buffer):
        if section == _COUNTS:
            self.counts = self.counts + np.frombuffer(data, np.int64)
            return
        self._upto(section)
        self.out.write(data)

    def close(self):
        self._upto(None)
        self.out.close()

    def _upto(self, section: int | None):
        if self.frame is None:
            return
        if self.left is None:
            self.left = self.frame(self.counts.tolist())
        while self.left and self.left[0] != section:
            item = self.left.pop(0)
            if isinstance(item, bytes):
                self.out.write(item)


class PartWriter(DataSourceArrowWriter):
    """Writes the parts of a table of encoded rows, sorted by file, section and number within each task."""

    def __init__(self, path: str, files: int, frame: Callable[[list[int]], list[bytes | int]] | None, job: str):
        self.path, self.files, self.frame = path, files, frame
        folder, name = os.path.split(path.rstrip("/"))
        self.folder = f"{folder}/.{name}-{job}" if folder else f".{name}-{job}"

    def write(self, iterator):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        system, folder = filesystem(self.folder)
        written, current, out = [], None, None
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            numbers, sections, data = (batch.column(c) for c in (_FILE, _SECTION, _DATA))
            for i, (number, section) in enumerate(zip(numbers.to_pylist(), sections.to_pylist())):
                if number != current:
                    if out is not None:
                        out.close()
                    current, name = number, f"{folder}/{number}-{attempt}"
                    out = _Frame(system.open_output_stream(name), self.frame)
                    written.append((number, name))
                out.add(section, data[i].as_buffer())
        if out is not None:
            out.close()
        return PartsWritten(written)

    def commit(self, messages):
        system, folder = filesystem(self.folder)
        _, target = filesystem(self.path)
        moves = [(name, part_name(target, k, self.files)) for message in messages if message for k, name in message.files]
        at_once(lambda move: system.move(*move), moves)
        system.delete_dir(folder)

    def abort(self, messages):
        system, folder = filesystem(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)
        # A commit that failed half way may have moved some.
        for message in messages:
            for k, name in message.files if message else []:
                place = filesystem(part_name(self.path, k, self.files))[1]
                gone = system.get_file_info(name).type == fs.FileType.NotFound
                if gone and system.get_file_info(place).type != fs.FileType.NotFound:
                    system.delete_file(place)


_PART, _PLACE = "_part", "_place"


@dataclass(frozen=True)
class Numbered:
    """A written table whose rows have a number that no later split changes."""

    df: DataFrame
    rows: int


def numbered(df: DataFrame) -> Numbered:
    """``df`` written once, every row with its global number in the order of partitions."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df = materialize(df.withColumns({_PART: F.spark_partition_id(), _PLACE: place}))
    # One row per partition.
    counts = df.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).orderBy(_PART).collect()
    starts, rows = [], 0
    for row in counts:
        starts.append((row[_PART], rows))
        rows += row["n"]
    begins = df.sparkSession.createDataFrame(starts, f"{_PART} int, _begin long")
    df = df.join(F.broadcast(begins), _PART).withColumn(_NUMBER, F.col("_begin") + F.col(_PLACE))
    return Numbered(df.drop(_PART, _PLACE, "_begin"), rows)


_ENCODED = f"{_FILE} long, {_SECTION} int, {_NUMBER} long, {_DATA} binary"


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 4
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[_FILE, _SECTION, _NUMBER, _DATA])


def _encoded_whole(table: Numbered, encode: Callable[[pa.Table], list[bytes]], rows_per_file: int) -> DataFrame:
    """As ``_encoded``, for an encoder that must see a part as a whole."""

    def whole(part):
        pieces = encode(part.sort_by(_NUMBER))
        return pa.Table.from_batches([_batch([(part.column(_FILE)[0].as_py(), i, 0, data) for i, data in enumerate(pieces)])])

    df = table.df.withColumn(_FILE, F.floor(F.col(_NUMBER) / rows_per_file))
    return df.groupBy(_FILE).applyInArrow(whole, _ENCODED)


def _encoded(table: Numbered, layout: Layout, rows_per_file: int) -> DataFrame:
    """(_file, _section, _number, _data): the bytes of every section of runs of consecutive rows of one part."""

    def encode(batches):
        for batch in batches:
            number = batch.column(_NUMBER).to_numpy()
            if len(number) and (np.diff(number) < 0).any():
                batch, number = batch.take(pa.array(np.argsort(number))), np.sort(number)
            cuts = np.flatnonzero((np.diff(number) != 1) | (np.diff(number // rows_per_file) != 0)) + 1
            rows = []
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                if start < stop:
                    counts, pieces = layout.encode(batch.slice(start, stop - start))
                    pieces = [(_COUNTS, np.array(counts, np.int64).tobytes()), *pieces]
                    first = int(number[start])
                    rows += [(first // rows_per_file, section, first, data) for section, data in pieces]
            yield _batch(rows)

    return table.df.mapInArrow(encode, _ENCODED)


def write_parts(
    table: Numbered, path: str, encode: Layout | Callable[[pa.Table], list[bytes]], rows_per_file: int = ROWS_PER_FILE
) -> int:
    """Writes every ``rows_per_file`` rows as a part; the number of parts.

    With a ``Layout`` no task holds the rows of a part; a plain function is given all of them, for small parts.
    """
    if not 0 < rows_per_file:
        raise ValueError("rows_per_file must be positive")
    if table.rows == 0:
        raise ValueError("the catalogue is empty")
    files = -(-table.rows // rows_per_file)
    system, _ = filesystem(path)
    for name in {path, *part_files(path)[:1]}:
        if system.get_file_info(filesystem(name)[1]).type != fs.FileType.NotFound:
            raise FileExistsError(name)
    job = uuid.uuid4().hex

    class Parts(DataSource):
        @classmethod
        def name(cls):
            return "particle_parts"

        def writer(self, schema, overwrite):
            return PartWriter(path, files, encode.frame if isinstance(encode, Layout) else None, job)

    spark = table.df.sparkSession
    spark.dataSource.register(Parts)
    # A task writes as many small files as make its rows.
    tasks = min(files, max(spark.sparkContext.defaultParallelism, -(-table.rows // ROWS_PER_TASK)))
    df = (_encoded if isinstance(encode, Layout) else _encoded_whole)(table, encode, rows_per_file)
    # Neighbouring files, as many to each task.
    df = df.repartitionById(tasks, F.floor(F.col(_FILE) * tasks / files).cast("int"))
    df = df.sortWithinPartitions(_FILE, _SECTION, _NUMBER)
    df.write.format("particle_parts").mode("append").save()
    return files
