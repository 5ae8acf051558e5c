"""Reading of fixed-width binary particle files in row ranges.

Every supported binary format is, past its header, a few arrays of fixed-width records. The
driver reads only headers; tasks seek to their own row ranges of the arrays they need.

Spark pushes comparisons of whole-number columns into the scan. Those on pid and on constants of a
file (the particle type) leave out row ranges and files unread; those on stored columns are decided
on their own array, and other arrays are read between the first and the last row that is left.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

ROWS_PER_TASK = 1 << 20
ROWS_PER_BATCH = 1 << 16
FILES_PER_TASK = 256


@dataclass(frozen=True)
class Block:
    """An array of records at ``offset``: (column, numpy format) per field."""

    offset: int
    fields: list[tuple[str, str]]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(name, fmt) for name, fmt in self.fields])


@dataclass(frozen=True)
class Segment:
    """``rows`` rows of one file; constants and factors apply to the columns of all of them."""

    path: str
    rows: int
    first_id: int
    blocks: list[Block]
    constants: dict[str, float]
    factors: dict[str, float]

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> "Segment":
        raw = json.loads(text)
        blocks = [Block(b["offset"], [tuple(f) for f in b["fields"]]) for b in raw.pop("blocks")]
        return Segment(blocks=blocks, **raw)


def open_file(path: str):
    """Local paths and every file system URI that Arrow knows."""
    from boxstats.sources.parts import filesystem

    system, inner = filesystem(path)
    return system.open_input_file(inner)


class RowRanges(InputPartition):
    """Ranges of rows (segment, start, stop) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


_COMPARE = {
    EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal,
}


class SegmentReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.types = [f.dataType.typeName() for f in schema.fields]
        self.segments = json.loads(options["segments"])
        self.step = int(options.get("rowsPerTask", ROWS_PER_TASK))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Takes comparisons of whole-number columns with a value; Spark keeps the others."""
        whole = {n for n, t in zip(self.names, self.types) if t in ("long", "integer")}
        for f in filters:
            path = getattr(f, "attribute", ())
            column = path[0] if len(path) == 1 else None
            if column in whole and type(f) in (*_COMPARE, In) and f.value is not None:
                self.filters.append((column, type(f), list(f.value) if type(f) is In else f.value))
            elif not (column in whole and type(f) is IsNotNull and column in ("pid", "ptype")):
                yield f

    def _keep(self, column: str, values: np.ndarray) -> np.ndarray:
        """Which values pass all filters of a column."""
        out = np.ones(len(values), bool)
        for name, kind, value in self.filters:
            if name == column:
                out &= np.isin(values, value) if kind is In else _COMPARE[kind](values, value)
        return out

    def partitions(self):
        ranges = []
        for text in self.segments:
            segment = Segment.load(text)
            stored = {name for block in segment.blocks for name, _ in block.fields}
            for name in {name for name, *_ in self.filters} - stored - {"pid"}:
                # A constant of the segment; a column that it lacks is null and passes no comparison.
                value = segment.constants.get(name)
                if value is None or not self._keep(name, np.array([value]))[0]:
                    break
            else:
                low, high = self._pid_range(segment)
                ranges += [(text, i, min(i + self.step, high)) for i in range(low, high, self.step)]
        # Ranges of small files share a task.
        tasks, rows = [], 0
        for text, start, stop in ranges:
            if not tasks or rows + stop - start > self.step or len(tasks[-1]) >= FILES_PER_TASK:
                tasks.append([])
                rows = 0
            tasks[-1].append((text, start, stop))
            rows += stop - start
        return [RowRanges(task) for task in tasks]

    def _pid_range(self, segment: Segment) -> tuple[int, int]:
        """First and end row of a segment that filters on pid leave."""
        low, high = segment.first_id, segment.first_id + segment.rows
        for name, kind, value in self.filters:
            if name == "pid":
                values = value if kind is In else [value]
                if kind in (EqualTo, In, GreaterThan, GreaterThanOrEqual):
                    low = max(low, min(values) + (kind is GreaterThan))
                if kind in (EqualTo, In, LessThan, LessThanOrEqual):
                    high = min(high, max(values) + (kind is not LessThan))
        return low - segment.first_id, max(high, low) - segment.first_id

    def read(self, partition):
        # There is no partition where no segment has rows.
        for text, start, stop in partition.ranges if partition else ():
            yield from self._read_range(Segment.load(text), start, stop)

    def _read_range(self, segment: Segment, start: int, stop: int):
        asked = {name for name, *_ in self.filters}
        pid = segment.first_id + np.arange(start, stop)
        kept = self._keep("pid", pid)
        columns = {}
        with open_file(segment.path) as file:

            def load(block, low, high):
                size = block.dtype.itemsize
                file.seek(block.offset + low * size)
                records = np.frombuffer(file.read((high - low) * size), block.dtype)
                if len(records) != high - low:
                    raise ValueError(f"{segment.path} is truncated")
                return records

            # Arrays that a filter looks at come first.
            first = [b for b in segment.blocks if asked & set(b.dtype.names)]
            for block in first:
                records = load(block, start, stop)
                for name in block.dtype.names:
                    columns[name] = records[name]
                    kept &= self._keep(name, records[name])
            rows = np.flatnonzero(kept)
            if not len(rows):
                return
            low, high = int(rows[0]), int(rows[-1]) + 1
            columns = {name: values[rows] for name, values in columns.items()}
            columns["pid"] = pid[rows]
            for block in segment.blocks:
                if block not in first and set(block.dtype.names) & set(self.names):
                    records = load(block, start + low, start + high)[rows - low]
                    columns |= {name: records[name] for name in block.dtype.names}
        count = len(rows)
        columns |= {name: np.full(count, value) for name, value in segment.constants.items()}
        arrays = []
        for name, kind in zip(self.names, self.types):
            if name not in columns:
                arrays.append(pa.nulls(count, _ARROW[kind]))
                continue
            values = columns[name].astype(_NUMPY[kind])
            if name in segment.factors:
                values = values * segment.factors[name]
            arrays.append(pa.array(values))
        whole = pa.RecordBatch.from_arrays(arrays, names=self.names)
        for at in range(0, count, ROWS_PER_BATCH):
            yield whole.slice(at, ROWS_PER_BATCH)


_NUMPY = {"double": np.float64, "long": np.int64, "integer": np.int32}
_ARROW = {"double": pa.float64(), "long": pa.int64(), "integer": pa.int32()}


class SegmentSource(DataSource):
    """``spark.read.format("particle_segments")``: options segments (JSON) and rowsPerTask."""

    @classmethod
    def name(cls):
        return "particle_segments"

    def reader(self, schema):
        return SegmentReader(schema, self.options)


def read_segments(
    spark: SparkSession, segments: list[Segment], schema: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    spark.dataSource.register(SegmentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (
        spark.read.format("particle_segments")
        .schema(schema)
        .option("segments", json.dumps([s.dump() for s in segments]))
        .option("rowsPerTask", str(rows_per_task))
        .load()
    )
