"""Column expressions for distances in a periodic box.

The box-to-box bounds take the same steps in the same order as the point distance
(difference, fold, square, sum). Each step is monotone under rounding, so a bound never
contradicts the distance of two points inside the boxes, to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = (0, 1, 2)
X = tuple(f"x{i}" for i in AXES)
V = tuple(f"v{i}" for i in AXES)


def not_finite(x: Column) -> Column:
    """NULL, NaN or infinite."""
    x = x.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def finite(x: Column, name: str) -> Column:
    """``x`` itself; a value that is no number stops the query instead of passing for one."""
    return F.when(not_finite(x), F.raise_error(F.lit(f"{name} is NULL, NaN or infinite"))).otherwise(x)


def wrap(x: Column, boxsize: float) -> Column:
    """Any image -> [0, L). What is no finite number stays none."""
    p = F.pmod(x, F.lit(float(boxsize)))
    return F.when(F.isnan(p), p).when(p >= boxsize, F.lit(0.0)).otherwise(p)


def min_image(dx: Column, boxsize: float) -> Column:
    """Signed separation folded to the nearest image; exact halves keep their sign."""
    size = F.lit(float(boxsize))
    return dx - size * F.rint(dx / size)


def dist2(a: list[str], b: list[str], boxsize: float) -> Column:
    """Squared distance of the points with the named coordinate columns."""
    size = f"{float(boxsize)!r}D"
    d = [f"({p} - {q} - {size} * rint(({p} - {q}) / {size}))" for p, q in zip(a, b)]
    return F.expr(" + ".join(f"{x} * {x}" for x in d))


def box_dist2(a: str, b: str, boxsize: float) -> tuple[Column, Column]:
    """(min, max) squared distance between points of two box structs with fields lo0..hi2."""
    size, half = f"{float(boxsize)!r}D", f"{0.5 * boxsize!r}D"
    least, largest = [], []
    for i in AXES:
        alo, ahi, blo, bhi = f"{a}.lo{i}", f"{a}.hi{i}", f"{b}.lo{i}", f"{b}.hi{i}"
        near = f"greatest(0D, {alo} - {bhi}, {blo} - {ahi})"
        far = f"greatest({ahi} - {blo}, {bhi} - {alo})"
        least.append(f"least({near}, {size} - {near}, {far}, {size} - {far})")
        largest.append(f"CASE WHEN {far} <= {half} THEN {far} WHEN {near} >= {half} THEN {size} - {near} ELSE {half} END")

    def squares(parts):
        return F.expr(" + ".join(f"({x}) * ({x})" for x in parts))

    return squares(least), squares(largest)
