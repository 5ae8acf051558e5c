"""HDF5 particle files: contiguous datasets in old-style groups, as the HDF5 library's
default (earliest) file format lays them out. The driver handles only the metadata; the
arrays are read in row ranges by the tasks, and written by them as files of bounded size.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from boxstats.functions.periodic import V, X
from boxstats.sources.parts import ROWS_PER_FILE, Layout, numbered, packed, part_files, write_parts
from boxstats.sources.segments import Block, Segment, open_file, read_segments

# Fixed values of the file format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 0xFFFFFFFFFFFFFFFF
MSG_DATASPACE = 0x01
MSG_DATATYPE = 0x03
MSG_LAYOUT = 0x08
MSG_CONTINUATION = 0x10
MSG_SYMBOL_TABLE = 0x11
CLASS_INTEGER = 0
CLASS_FLOAT = 1
LEAF_RANK = 4
NODE_RANK = 16


@dataclass(frozen=True)
class Dataset:
    shape: tuple[int, ...]
    fmt: str
    offset: int


def _at(file, offset: int, fmt: str):
    file.seek(offset)
    data = file.read(struct.calcsize(fmt))
    return struct.unpack(fmt, data)


def _messages(file, address: int):
    """(type, body) of a version 1 object header, continuation blocks included."""
    version, _, count, _, size = _at(file, address, "<BBHII")
    if version != 1:
        raise ValueError(f"object header version {version} is not supported")
    spans = [(address + 16, size)]
    while spans and count:
        start, length = spans.pop(0)
        end = start + length
        while start + 8 <= end and count:
            kind, body, _ = _at(file, start, "<HHB3x")
            file.seek(start + 8)
            data = file.read(body)
            count -= 1
            start += 8 + body
            if kind == MSG_CONTINUATION:
                spans.append(struct.unpack("<QQ", data[:16]))
            else:
                yield kind, data


def _members(file, btree: int, heap: int):
    """(name, object header address) of a group."""
    (data_segment,) = _at(file, heap + 24, "<Q")
    signature, kind, level, used = _at(file, btree, "<4sBBH")
    if signature != b"TREE" or kind != 0:
        raise ValueError("not a group node")
    entries = _at(file, btree + 24, f"<{2 * used + 1}Q")
    for child in entries[1::2]:
        if level > 0:
            yield from _members(file, child, heap)
            continue
        node, _, n = _at(file, child, "<4sBxH")
        if node != b"SNOD":
            raise ValueError("not a symbol node")
        for i in range(n):
            name_offset, header = _at(file, child + 8 + 40 * i, "<QQ")
            file.seek(data_segment + name_offset)
            name = b""
            while b"\0" not in name:
                chunk = file.read(64)
                if not chunk:
                    break
                name += chunk
            yield name.split(b"\0")[0].decode(), header


def _datatype(data: bytes) -> str:
    kind, bits, size = data[0] & 0x0F, data[1], struct.unpack_from("<I", data, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == CLASS_FLOAT:
        return f"{order}f{size}"
    if kind == CLASS_INTEGER:
        return f"{order}{'i' if bits & 8 else 'u'}{size}"
    raise ValueError(f"datatype class {kind} is not supported")


def _layout(data: bytes) -> int:
    if data[0] == 3 and data[1] == 1:
        return struct.unpack_from("<Q", data, 2)[0]
    if data[0] in (1, 2) and data[2] == 1:
        return struct.unpack_from("<Q", data, 8)[0]
    raise ValueError("only contiguous datasets are supported")


def list_datasets(file, address: int | None = None, prefix: str = "") -> dict[str, Dataset]:
    """Every contiguous dataset below a group, by path."""
    if address is None:
        file.seek(0)
        if file.read(8) != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version, offsets, lengths = _at(file, 8, "<B4xBB")
        if version > 1 or offsets != 8 or lengths != 8:
            raise ValueError(f"superblock version {version} is not supported")
        (address,) = _at(file, (56 if version == 0 else 60) + 8, "<Q")
    found = {kind: data for kind, data in _messages(file, address)}
    if MSG_SYMBOL_TABLE in found:
        btree, heap = struct.unpack_from("<QQ", found[MSG_SYMBOL_TABLE])
        datasets = {}
        for name, header in _members(file, btree, heap):
            datasets |= list_datasets(file, header, f"{prefix}/{name}")
        return datasets
    space = found[MSG_DATASPACE]
    dims_at = 8 if space[0] == 1 else 4
    shape = struct.unpack_from(f"<{space[1]}Q", space, dims_at)
    return {prefix: Dataset(shape, _datatype(found[MSG_DATATYPE]), _layout(found[MSG_LAYOUT]))}


def _scalar(file, dataset: Dataset) -> float:
    order, kind = dataset.fmt[0], dataset.fmt[1:]
    code = {"f4": "f", "f8": "d", "i4": "i", "u4": "I", "i8": "q", "u8": "Q"}[kind]
    return float(_at(file, dataset.offset, order + code)[0])


def read_particles(
    spark: SparkSession, path: str, rows_per_task: int | None = None, columns: tuple[str, ...] | None = None
) -> tuple[DataFrame, dict[str, float]]:
    """pid (row number), x0..x2, v0..v2, nfof if present; and the scalars of /parameters. ``path`` may stand for
    numbered parts. ``columns`` leaves out all but these; arrays of others are never read."""
    segments, parameters, first, grouped = [], {}, 0, False
    for name in part_files(path):
        with open_file(name) as file:
            datasets = list_datasets(file)
            parameters = {
                key.split("/")[-1]: _scalar(file, d) for key, d in datasets.items() if key.startswith("/parameters/") and not d.shape
            }
        x, v = datasets["/x"], datasets["/v"]
        blocks = [Block(x.offset, [(c, x.fmt) for c in X]), Block(v.offset, [(c, v.fmt) for c in V])]
        if "/nfof" in datasets:
            nfof, grouped = datasets["/nfof"], True
            blocks.append(Block(nfof.offset, [("nfof", nfof.fmt)]))
        segments.append(Segment(name, x.shape[0], first, blocks, {}, {}))
        first += x.shape[0]
    if first == 0:
        raise ValueError(f"{path} holds no particles")
    kinds = {"pid": "bigint"} | {c: "double" for c in (*X, *V)} | ({"nfof": "int"} if grouped else {})
    chosen = [c for c in kinds if columns is None or c == "pid" or c in columns]
    schema = ", ".join(f"{c} {kinds[c]}" for c in chosen)
    options = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    return read_segments(spark, segments, schema, **options), parameters


class _Image:
    """Metadata of a new file: groups of datasets, with room for the arrays behind it."""

    def __init__(self):
        self.data = bytearray()

    def reserve(self, size: int) -> int:
        self.data += b"\0" * (-len(self.data) % 8)
        at = len(self.data)
        self.data += b"\0" * size
        return at

    def put(self, at: int, fmt: str, *values):
        struct.pack_into(fmt, self.data, at, *values)

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        padded = [(kind, body + b"\0" * (-len(body) % 8)) for kind, body in messages]
        size = sum(8 + len(body) for _, body in padded)
        at = self.reserve(16 + size)
        self.put(at, "<BBHII", 1, 0, len(padded), 1, size)
        cursor = at + 16
        for kind, body in padded:
            self.put(cursor, "<HHB3x", kind, len(body), 0)
            self.data[cursor + 8 : cursor + 8 + len(body)] = body
            cursor += 8 + len(body)
        return at

    def dataset(self, fmt: str, shape: tuple[int, ...], offset: int, size: int) -> int:
        space = struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)
        layout = struct.pack("<BBQQ", 3, 1, offset, size)
        return self.header([(MSG_DATASPACE, space), (MSG_DATATYPE, _TYPES[fmt]), (MSG_LAYOUT, layout)])

    def group(self, members: dict[str, int]) -> tuple[int, int, int]:
        """Returns (object header, B-tree, heap) addresses; members are in name order."""
        if len(members) > 2 * LEAF_RANK:
            raise ValueError("too many members for one symbol node")
        names, offsets = bytearray(8), []
        for name in sorted(members):
            offsets.append(len(names))
            names += name.encode() + b"\0"
            names += b"\0" * (-len(names) % 8)
        segment = self.reserve(len(names))
        self.data[segment : segment + len(names)] = names
        heap = self.reserve(32)
        self.put(heap, "<4sB3xQQQ", b"HEAP", 0, len(names), 1, segment)
        node = self.reserve(8 + 40 * 2 * LEAF_RANK)
        self.put(node, "<4sBxH", b"SNOD", 1, len(members))
        for i, name in enumerate(sorted(members)):
            self.put(node + 8 + 40 * i, "<QQ", offsets[i], members[name])
        tree = self.reserve(24 + 8 * (4 * NODE_RANK + 1))
        self.put(tree, "<4sBBHQQ", b"TREE", 0, 0, 1, UNDEFINED, UNDEFINED)
        self.put(tree + 24, "<QQQ", 0, node, offsets[-1])
        return self.header([(MSG_SYMBOL_TABLE, struct.pack("<QQ", tree, heap))]), tree, heap


# Datatype messages: class and version, bit field, size, bit offset and precision, and for
# floats the exponent and mantissa layout and bias (fixed values of the format).
_TYPES = {
    "<f4": struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 31, 0, 4, 0, 32, 23, 8, 0, 23, 127),
    "<f8": struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023),
    "<u4": struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 4, 0, 32),
}


def _metadata(parameters: dict[str, float], arrays: dict[str, tuple[str, tuple[int, ...]]]) -> tuple[bytes, dict[str, int]]:
    """The bytes of a file before its arrays, and the size of every array with its padding."""
    image = _Image()
    image.reserve(96)
    sizes = {}
    for name, (fmt, shape) in arrays.items():
        count = 1
        for n in shape:
            count *= n
        sizes[name] = count * int(fmt[2:])
    scalars = image.reserve(8 * len(parameters))
    group = {}
    for i, (name, value) in enumerate(parameters.items()):
        image.put(scalars + 8 * i, "<d", float(value))
        group[name] = image.dataset("<f8", (), scalars + 8 * i, 8)
    headers = {}
    for name, (fmt, shape) in arrays.items():
        headers[name] = image.dataset(fmt, shape, 0, sizes[name])
    members = {n: h for n, h in headers.items()}
    if group:
        members["parameters"] = image.group(group)[0]
    root, tree, heap = image.group(members)
    end = len(image.data) + (-len(image.data) % 8)
    for name, (fmt, shape) in arrays.items():
        # The layout message is the last of the header: version, class, address, size.
        body = 16 + (8 + 8 + 8 * len(shape)) + (8 + len(_TYPES[fmt]) + (-len(_TYPES[fmt]) % 8)) + 8
        image.put(headers[name] + body + 2, "<Q", end)
        end += sizes[name] + (-sizes[name] % 8)
    image.data[0:8] = SIGNATURE
    image.put(8, "<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, LEAF_RANK, NODE_RANK, 0)
    image.put(24, "<QQQQ", 0, UNDEFINED, end, UNDEFINED)
    image.put(56, "<QQIIQQ", 0, root, 1, 0, tree, heap)
    data = bytes(image.data) + b"\0" * (-len(image.data) % 8)
    return data, {name: size + (-size % 8) for name, size in sizes.items()}


def write_arrays(
    df: DataFrame,
    path: str,
    parameters: dict[str, float],
    arrays: dict[str, list[tuple[str, str]]],
    shape: tuple[int, ...] | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> int:
    """``arrays`` maps a dataset to its (column, format) fields: one row of df per record.
    ``shape`` folds the rows of single-column datasets into more dimensions.

    Rows keep the order of the partitions of ``df``. More than ``rows_per_file`` rows become numbered files, each
    with all parameters.
    """
    table = numbered(df.select(*[c for fields in arrays.values() for c, _ in fields]))

    def frame(counts):
        n = counts[0]
        shapes = {name: (f[0][1], (n, len(f)) if len(f) > 1 else shape or (n,)) for name, f in arrays.items()}
        head, sizes = _metadata(parameters, shapes)
        pieces = [head]
        for section, (name, fields) in enumerate(arrays.items()):
            pieces += [section, bytes(sizes[name] - n * np.dtype(fields).itemsize)]
        return pieces

    layout = Layout(lambda rows: ([rows.num_rows], [(i, packed(rows, f)) for i, f in enumerate(arrays.values())]), frame)
    write_parts(table, path, layout, rows_per_file)
    return table.rows


def write_particles(df: DataFrame, path: str, parameters: dict[str, float], rows_per_file: int = ROWS_PER_FILE) -> int:
    """/parameters scalars, /x and /v (float32), and /nfof where the catalogue has it."""
    arrays = {"x": [(c, "<f4") for c in X], "v": [(c, "<f4") for c in V]}
    if "nfof" in df.columns:
        arrays["nfof"] = [("nfof", "<u4")]
    return write_arrays(df, path, parameters, arrays, rows_per_file=rows_per_file)
