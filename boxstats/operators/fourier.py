"""Three-dimensional real-to-complex Fourier transform of a mesh DataFrame.

Spark shuffles the mesh into groups that hold whole lines along one axis, and each group
is transformed in its task. Groups are bounded by the mesh side, never by the catalogue:
lines are gathered in blocks of about LINE_CELLS cells, and a plane is transformed in one
step only up to PLANE_CELLS. The cells of a mesh are unique, so no group is skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_CELLS = 1 << 16
PLANE_CELLS = 1 << 21


def fft_mesh(
    mesh: DataFrame,
    nc: int,
    fields: list[str],
    keys: list[str] = (),
    line_cells: int = LINE_CELLS,
    plane_cells: int = PLANE_CELLS,
) -> DataFrame:
    """Unnormalised forward transform exp(-2 pi i k.x / nc) of every real field.

    Returns the half spectrum ix, iy in [0, nc), iz in [0, nc/2] with ``<field>_re`` and
    ``<field>_im``. Cells absent from ``mesh`` count as zero. All fields go through the
    same passes; ``keys`` separate independent meshes (such as distortion strengths).
    """
    parts = [f"{f}_{p}" for f in fields for p in ("re", "im")]
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in mesh.schema.fields if f.name in keys]
    spectrum = ", ".join(key_types + ["ix int", "iy int", "iz int"] + [f"{p} double" for p in parts])

    def regroup(df, lines, per_line):
        block = max(1, line_cells // per_line)
        return df.withColumn("_g", F.expr(f"cast(({lines}) div {block} as int)")).groupBy(*keys, "_g")

    line_z = _line_transform(nc, "iz", ("ix", "iy"), fields, list(keys), real=True)
    step = regroup(mesh, f"cast(ix as bigint) * {nc} + iy", nc).applyInArrow(line_z, spectrum)
    if nc * nc <= plane_cells:
        plane = _plane_transform(nc, fields, list(keys))
        return regroup(step, "iz", nc * nc).applyInArrow(plane, spectrum)
    line_y = _line_transform(nc, "iy", ("ix", "iz"), fields, list(keys), real=False)
    line_x = _line_transform(nc, "ix", ("iy", "iz"), fields, list(keys), real=False)
    step = regroup(step, f"cast(iz as bigint) * {nc} + ix", nc).applyInArrow(line_y, spectrum)
    return regroup(step, f"cast(iz as bigint) * {nc} + iy", nc).applyInArrow(line_x, spectrum)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _values(table: pa.Table, field: str, real: bool) -> np.ndarray:
    if real:
        return _column(table, field)
    return _column(table, f"{field}_re") + 1j * _column(table, f"{field}_im")


def _emit(table, keys, index, spectra) -> pa.Table:
    n = len(index["ix"])
    columns = {k: pa.repeat(table.column(k)[0], n) for k in keys}
    columns |= {i: pa.array(index[i].astype(np.int32)) for i in ("ix", "iy", "iz")}
    for field, values in spectra.items():
        columns[f"{field}_re"] = pa.array(np.ascontiguousarray(values.real))
        columns[f"{field}_im"] = pa.array(np.ascontiguousarray(values.imag))
    return pa.table(columns)


def _line_transform(nc, axis, others, fields, keys, real):
    """Transform of the lines along ``axis`` that a group holds."""

    def transform(table: pa.Table) -> pa.Table:
        first, second = (_column(table, o).astype(np.int64) for o in others)
        lines, row = np.unique(first * nc + second, return_inverse=True)
        at = _column(table, axis)
        length = nc // 2 + 1 if real else nc
        spectra = {}
        for f in fields:
            dense = np.zeros((len(lines), nc), float if real else complex)
            dense[row, at] = _values(table, f, real)
            spectra[f] = (np.fft.rfft if real else np.fft.fft)(dense, axis=1).ravel()
        index = {
            others[0]: np.repeat(lines // nc, length),
            others[1]: np.repeat(lines % nc, length),
            axis: np.tile(np.arange(length), len(lines)),
        }
        return _emit(table, keys, index, spectra)

    return transform


def _plane_transform(nc, fields, keys):
    """Transform over x and y of the iz planes that a group holds."""

    def transform(table: pa.Table) -> pa.Table:
        planes, row = np.unique(_column(table, "iz"), return_inverse=True)
        at = row, _column(table, "ix"), _column(table, "iy")
        spectra = {}
        for f in fields:
            dense = np.zeros((len(planes), nc, nc), complex)
            dense[at] = _values(table, f, real=False)
            spectra[f] = np.fft.fft2(dense, axes=(1, 2)).ravel()
        iz, ix, iy = np.meshgrid(planes, np.arange(nc), np.arange(nc), indexing="ij")
        return _emit(table, keys, {"ix": ix.ravel(), "iy": iy.ravel(), "iz": iz.ravel()}, spectra)

    return transform
