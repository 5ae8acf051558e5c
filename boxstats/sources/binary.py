"""The binary snapshot, subsample and group formats; all may come in numbered parts."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import V, X
from boxstats.operators.transforms import wrap_positions
from boxstats.sources.parts import ROWS_PER_FILE, Layout, at_once, numbered, packed, part_files, write_parts
from boxstats.sources.segments import Block, Segment, open_file, read_segments

PARTICLE_SCHEMA = "pid bigint, " + ", ".join(f"{c} double" for c in (*X, *V))

# Fixed values of the file formats.
GROUP_MAGIC = 604
HEADER_BYTES = 256
PARTICLE_TYPES = 6
HALO_TYPE = 1


class FormatError(ValueError):
    pass


def _take(file, fmt: str):
    size = struct.calcsize(fmt)
    data = file.read(size)
    if len(data) != size:
        raise FormatError("unexpected end of file")
    return struct.unpack(fmt, data)


def _single(column: str) -> list[tuple[str, str]]:
    return [(column, "<f4")]


def _records(path: str, head: str, fields: list[tuple[str, str]], check) -> tuple[list[Segment], tuple]:
    """Segments of files of a header that ends in a row count, rows, and the count again; and the header."""

    def look(name):
        with open_file(name) as file:
            *header, n = _take(file, head)
            check(name, header)
            block = Block(file.tell(), fields)
            file.seek(block.offset + n * block.dtype.itemsize)
            (again,) = _take(file, "<i")
        if again != n:
            raise FormatError(f"{name}: trailing count {again} differs from {n}")
        return header, n, block

    segments, first, header = [], 0, ()
    names = part_files(path)
    for name, (header, n, block) in zip(names, at_once(look, names)):
        segments.append(Segment(name, n, first, [block], {}, {}))
        first += n
    return segments, tuple(header)


_PARTICLE_FIELDS = [(c, "<f4") for c in (*X, *V)]
_GROUP_FIELDS = [("nfof", "<i4"), *_PARTICLE_FIELDS]


def read_subsample_binary(spark: SparkSession, path: str) -> tuple[DataFrame, Box]:
    """Header of 6 floats (boxsize, -, omega_m, -, a, -), row count, rows of x and v, row count."""
    segments, header = _records(path, "<6fi", _PARTICLE_FIELDS, lambda *_: None)
    return read_segments(spark, segments, PARTICLE_SCHEMA), Box(header[0], header[2], header[4])


def read_fof_binary(spark: SparkSession, path: str, nfof_min: int = 0) -> tuple[DataFrame, float]:
    """Group catalogue; returns the rows with nfof >= nfof_min, which the scan decides, and the boxsize."""

    def check(name, header):
        if header[0] != GROUP_MAGIC:
            raise FormatError(f"{name} is not a group catalogue")

    segments, header = _records(path, "<iffi", _GROUP_FIELDS, check)
    schema = PARTICLE_SCHEMA.replace("pid bigint", "pid bigint, nfof int")
    df = read_segments(spark, segments, schema)
    return df.filter(df["nfof"] >= nfof_min), header[2]


def _write_records(df: DataFrame, path: str, head: bytes, fields: list[tuple[str, str]], rows_per_file: int) -> int:
    table = numbered(df.select(*[c for c, _ in fields]))

    def frame(counts):
        count = struct.pack("<i", counts[0])
        return [head + count, 0, count]

    layout = Layout(lambda rows: ([rows.num_rows], [(0, packed(rows, fields))]), frame)
    write_parts(table, path, layout, rows_per_file)
    return table.rows


def write_subsample_binary(df: DataFrame, path: str, box: Box, rows_per_file: int = ROWS_PER_FILE) -> int:
    """x and v of every row, in the order of the partitions of ``df``."""
    return _write_records(df, path, struct.pack("<6f", box.boxsize, 0, box.omega_m, 0, box.a, 0), _PARTICLE_FIELDS, rows_per_file)


def write_fof_binary(df: DataFrame, path: str, box: Box, linking_length: float = 0.2, rows_per_file: int = ROWS_PER_FILE) -> int:
    """nfof, x and v of every row, in the order of the partitions of ``df``."""
    return _write_records(df, path, struct.pack("<iff", GROUP_MAGIC, linking_length, box.boxsize), _GROUP_FIELDS, rows_per_file)


@dataclass(frozen=True)
class SnapshotHeader:
    counts: tuple[int, ...]
    masses: tuple[float, ...]
    time: float
    redshift: float
    cooling: int
    num_files: int
    boxsize: float
    omega_m: float
    omega_lambda: float
    hubble: float
    totals: tuple[int, ...]

    @property
    def box(self) -> Box:
        return Box(self.boxsize, self.omega_m, self.time)


# Fixed layout of the snapshot header: counts, masses, time, redshift, two flags, totals,
# cooling flag, file count, boxsize, densities, Hubble parameter, two flags, high words.
_HEADER = "<6i6d2d2i6I2i4d2i6I"


def pack_header(h: SnapshotHeader) -> bytes:
    low = [t & 0xFFFFFFFF for t in h.totals]
    high = [t >> 32 for t in h.totals]
    data = struct.pack(
        _HEADER, *h.counts, *h.masses, h.time, h.redshift, 0, 0, *low, h.cooling, h.num_files,
        h.boxsize, h.omega_m, h.omega_lambda, h.hubble, 0, 0, *high,
    )
    return data.ljust(HEADER_BYTES, b"\0")


def read_snapshot_header(file) -> SnapshotHeader:
    (before,) = _take(file, "<i")
    raw = file.read(HEADER_BYTES)
    (after,) = _take(file, "<i")
    if before != HEADER_BYTES or after != HEADER_BYTES:
        raise FormatError(f"header record marks {before}, {after}")
    v = struct.unpack_from(_HEADER, raw)
    return SnapshotHeader(
        counts=v[0:6], masses=v[6:12], time=v[12], redshift=v[13], cooling=v[22], num_files=v[23],
        boxsize=v[24], omega_m=v[25], omega_lambda=v[26], hubble=v[27],
        totals=tuple(low + (high << 32) for low, high in zip(v[16:22], v[30:36])),
    )


def _snapshot_blocks(path: str, file, header: SnapshotHeader) -> dict[int, list[Block]]:
    """Arrays of every particle type, from the record marks of one file."""
    n = header.counts
    blocks: dict[int, list[Block]] = {t: [] for t in range(PARTICLE_TYPES)}

    def record(types: list[int], fields, widths=None):
        """One record holds the arrays of ``types`` one after another."""
        total = sum(n[t] for t in types)
        if total == 0:
            return
        (size,) = _take(file, "<i")
        start = file.tell()
        layout = fields
        if widths is not None:
            if size % total or size // total not in widths:
                raise FormatError(f"{path}: record of {size} bytes for {total} rows")
            layout = [(name, widths[size // total]) for name, _ in fields]
        for t in types:
            block = Block(start, layout)
            if n[t]:
                blocks[t].append(block)
            start += n[t] * block.dtype.itemsize
        if start - file.tell() != size:
            raise FormatError(f"{path}: record of {size} bytes, expected {start - file.tell()}")
        file.seek(start)
        (end,) = _take(file, "<i")
        if end != size:
            raise FormatError(f"{path}: record marks {size} and {end} differ")

    every = list(range(PARTICLE_TYPES))
    record(every, [(c, "<f4") for c in X])
    record(every, [(c, "<f4") for c in V])
    record(every, [("id", "<u4")], {4: "<u4", 8: "<u8"})
    record([t for t in every if header.masses[t] == 0], _single("m"))
    gas = ["u", "rho"] + (["ne"] if header.cooling else []) + ["hsml"]
    for column in gas:
        if not n[0] or not file.read(1):
            break
        file.seek(-1, 1)
        record([0], _single(column))
    return blocks


SNAPSHOT_COLUMNS = ("ptype", "id", "m", "u", "rho", "hsml")


def read_snapshot(
    spark: SparkSession,
    path: str,
    ptypes: tuple[int, ...] = (HALO_TYPE,),
    columns: tuple[str, ...] = (),
    physical_positions: bool = False,
    rows_per_task: int | None = None,
) -> tuple[DataFrame, Box]:
    """Particles of the chosen types, velocities in km/s, positions wrapped into the box.

    ``columns`` adds some of SNAPSHOT_COLUMNS (NULL where a type lacks the quantity); arrays
    of columns that are not asked for are never read.
    """
    unknown = set(columns) - set(SNAPSHOT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown snapshot columns {sorted(unknown)}")
    segments, first, header, seen = [], 0, None, 0
    for name in part_files(path):
        with open_file(name) as file:
            header = read_snapshot_header(file)
            blocks = _snapshot_blocks(name, file, header)
        seen += 1
        factor = math.sqrt(header.time)
        for t in ptypes:
            constants = {"ptype": float(t)}
            if header.masses[t] != 0:
                constants["m"] = header.masses[t]
            if header.counts[t]:
                factors = {v: factor for v in V}
                segments.append(Segment(name, header.counts[t], first, blocks[t], constants, factors))
            first += header.counts[t]
    if header.num_files > 1 and seen != header.num_files:
        raise FormatError(f"{path}: {seen} of {header.num_files} files found")
    kinds = {"ptype": "int", "id": "bigint"}
    schema = PARTICLE_SCHEMA + "".join(f", {c} {kinds.get(c, 'double')}" for c in columns)
    options = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    df = wrap_positions(read_segments(spark, segments, schema, **options), header.box)
    found = header.box
    if physical_positions:
        # The box shrinks with its positions, so that distances fold at its walls.
        df = df.withColumns({c: df[c] * header.time for c in X})
        found = Box(found.boxsize * header.time, found.omega_m, found.a)
    return df, found


def write_snapshot(
    df: DataFrame, path: str, box: Box, mass: float | dict[int, float] = 0.0, hubble: float = 0.7, rows_per_file: int = ROWS_PER_FILE
) -> int:
    """A snapshot of x, v and pid as id, velocities back in file units, in parts of ``rows_per_file`` rows.

    A column ``ptype`` gives the particle types (all of halo type without it). ``mass`` is the mass of that
    type, or of several by type; particles of other types need a column ``m``, which is stored for them.
    Gas (type 0) has a record of internal energy ``u`` (0 where it is absent or NULL), and records of ``rho``, ``ne`` and
    ``hsml`` if there are such columns. A record of 2 GB is the most that its marks can hold.
    """
    masses = mass if isinstance(mass, dict) else {HALO_TYPE: mass} if mass else {}
    if any(not m > 0 for m in masses.values()):
        raise ValueError("masses of particle types must be positive")
    typed = "ptype" in df.columns
    gas = ["u", *[c for c in ("rho", "ne", "hsml") if c in df.columns]]
    if "hsml" in gas and "rho" not in gas:
        raise ValueError("hsml without rho cannot be told from it")
    if rows_per_file * 12 > (1 << 31) - 1:
        raise ValueError("a record would pass 2 GB")
    root = F.lit(math.sqrt(box.a))
    kind = F.col("ptype").cast("int") if typed else F.lit(HALO_TYPE)
    optional = [F.coalesce(c, F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in gas]
    own = F.col("m").cast("double").alias("m") if "m" in df.columns else F.lit(None).cast("double").alias("m")
    table = numbered(df.select("pid", *X, *[(F.col(v) / root).alias(v) for v in V], kind.alias("ptype"), own, *optional))
    given = F.col("ptype").isin(list(masses)) if masses else F.lit(False)
    facts = table.df.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("top"), F.max((~given & F.col("m").isNull()).cast("int")).alias("bare"))
    found = {r["ptype"]: r for r in facts.collect()}
    if unknown := [t for t in found if t is None or not 0 <= t < PARTICLE_TYPES]:
        raise ValueError(f"unknown particle types {unknown}")
    if bare := sorted(t for t, r in found.items() if r["bare"]):
        raise ValueError(f"a snapshot needs a positive particle mass, or a column m, for types {bare}")
    every = range(PARTICLE_TYPES)
    totals = tuple(found[t]["n"] if t in found else 0 for t in every)
    files = max(1, -(-table.rows // rows_per_file))
    base = SnapshotHeader(
        totals, tuple(masses.get(t, 0.0) for t in every), box.a, box.z, int("ne" in gas), files, box.boxsize, box.omega_m,
        1.0 - box.omega_m, hubble, totals,
    )
    wide = "<u8" if max((r["top"] for r in found.values()), default=0) >= 1 << 32 else "<u4"

    # Fields of every record, and the types that have it; a section is what one type has in one record.
    records = [([(c, "<f4") for c in X], every), ([(c, "<f4") for c in V], every), ([("pid", wide)], every)]
    records += [(_single("m"), [t for t in every if t not in masses])] + [(_single(c), [0]) for c in gas]

    def encode(rows):
        kinds = rows.column("ptype").to_numpy()
        counts = np.bincount(kinds, minlength=PARTICLE_TYPES).tolist()
        alike = {t: rows if counts[t] == rows.num_rows else rows.filter(pa.array(kinds == t)) for t in every if counts[t]}
        return counts, [
            (PARTICLE_TYPES * i + t, packed(alike[t], fields)) for i, (fields, types) in enumerate(records) for t in types if t in alike
        ]

    def frame(counts):
        mark = struct.pack("<i", HEADER_BYTES)
        pieces = [mark + pack_header(replace(base, counts=tuple(counts))) + mark]
        for i, (fields, types) in enumerate(records):
            if n := sum(counts[t] for t in types):
                mark = struct.pack("<i", n * np.dtype(fields).itemsize)
                pieces += [mark, *[PARTICLE_TYPES * i + t for t in types], mark]
        return pieces

    write_parts(table, path, Layout(encode, frame), rows_per_file)
    return table.rows
