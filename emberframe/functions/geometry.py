"""Vectors and periodic cells as column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str, names: Sequence[str] = ("x", "y", "z")) -> Vector:
    return tuple(F.col(f"{prefix}{n}") for n in names)  # type: ignore[return-value]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def rint(x: float) -> float:
    """The nearest whole number, halves to even; numbers that are not finite as they are."""
    return float(round(x)) if math.isfinite(x) else x


class Box:
    """An orthorhombic cell in the columns lx, ly, lz of the frames."""

    columns: tuple[str, ...] = ("lx", "ly", "lz")

    def __init__(self, get: Callable[[str], Column] = F.col):
        """get: from the name of a cell's column to the column, where it is not one of the row's own."""
        self.get = get

    def lengths(self) -> Vector:
        return self.get("lx"), self.get("ly"), self.get("lz")

    def rounded(self, d: Vector) -> Vector:
        """The image in the cell around the origin, by rounding: the nearest one in a box."""
        return self.mic(d)

    def fractional(self, p: Vector) -> Vector:
        return tuple(x / length for x, length in zip(p, self.lengths()))  # type: ignore[return-value]

    def heights(self) -> Vector:
        """The distances between opposite faces."""
        return self.lengths()

    def matrix(self) -> Column:
        """The cell's vectors as an array of rows."""
        zero = F.lit(0.0)
        return F.array(*[F.array(*[length.cast("double") if i == k else zero for k in range(3)]) for i, length in enumerate(self.lengths())])

    def numbers(self) -> list[Column]:
        """The cell as plain numbers, for image()."""
        return [length.cast("double") for length in self.lengths()]

    @staticmethod
    def image(d: Sequence[float], cell: Sequence[float]) -> Sequence[float]:
        """rounded() of plain numbers, with the same operations in the same order; cell as numbers() has it."""
        return [x - length * rint(x / length) for x, length in zip(d, cell)]

    def mic(self, d: Vector) -> Vector:
        """The nearest image: each component less a whole number of lengths, rounded half to even."""
        return tuple(x - length * F.rint(x / length) for x, length in zip(d, self.lengths()))  # type: ignore[return-value]

    def wrap(self, p: Vector) -> Vector:
        return tuple(x - length * F.floor(x / length) for x, length in zip(p, self.lengths()))  # type: ignore[return-value]

    def volume(self) -> Column:
        x, y, z = self.lengths()
        return F.abs(x * y * z)

    def mean_length(self) -> Column:
        x, y, z = self.lengths()
        return (x + y + z) / 3.0

    def center(self) -> Vector:
        return tuple(length / 2.0 for length in self.lengths())  # type: ignore[return-value]


class Cell(Box):
    """Any cell: the column cell holds its three vectors as rows. The nearest of 27 images is exact for reduced cells."""

    columns = ("cell",)

    def _rows(self) -> list[Vector]:
        return [tuple(self.get("cell")[i][k] for k in range(3)) for i in range(3)]  # type: ignore[misc]

    def fractional(self, d: Vector) -> Vector:
        a, b, c = self._rows()
        det = dot(a, cross(b, c))
        return dot(d, cross(b, c)) / det, dot(d, cross(c, a)) / det, dot(d, cross(a, b)) / det

    def _cartesian(self, f: Vector) -> Vector:
        rows = self._rows()
        return tuple(f[0] * rows[0][k] + f[1] * rows[1][k] + f[2] * rows[2][k] for k in range(3))  # type: ignore[return-value]

    def heights(self) -> Vector:
        a, b, c = self._rows()
        volume = self.volume()
        return volume / norm(cross(b, c)), volume / norm(cross(c, a)), volume / norm(cross(a, b))

    def matrix(self) -> Column:
        return self.get("cell")

    def rounded(self, d: Vector) -> Vector:
        return self._cartesian(tuple(f - F.rint(f) for f in self.fractional(d)))  # type: ignore[arg-type]

    def numbers(self) -> list[Column]:
        return [x.cast("double") for row in self._rows() for x in row]

    @staticmethod
    def image(d: Sequence[float], cell: Sequence[float]) -> Sequence[float]:
        a, b, c = cell[:3], cell[3:6], cell[6:]
        sides = cross(b, c), cross(c, a), cross(a, b)  # type: ignore[arg-type]
        det = dot(a, sides[0])  # type: ignore[arg-type]
        f = [dot(d, side) / det for side in sides]  # type: ignore[arg-type]
        f = [x - rint(x) for x in f]  # type: ignore[arg-type]
        return [f[0] * a[k] + f[1] * b[k] + f[2] * c[k] for k in range(3)]  # type: ignore[return-value]

    def nearest(self, d: Vector) -> Column:
        """An array of one struct (d2, x, y, z): the nearest image and its squared length, computed once for all uses by inlining the array."""
        # as higher-order functions, since 27 images written out, once for each use of the result, are too much code for a join's condition
        rows = self._rows()
        steps = F.array(F.lit(0.0), F.lit(-1.0), F.lit(1.0))

        def image(f: Column, i: Column, j: Column, k: Column) -> Column:
            p = [(f["x"] + i) * rows[0][n] + (f["y"] + j) * rows[1][n] + (f["z"] + k) * rows[2][n] for n in range(3)]
            return F.struct(dot(p, p).alias("d2"), *[c.alias(name) for c, name in zip(p, "xyz")])  # type: ignore[arg-type]

        def around(f: Column) -> Column:
            return F.array_min(F.flatten(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.transform(steps, lambda k: image(f, i, j, k)))))))

        parts = F.struct(*[(x - F.rint(x)).alias(name) for x, name in zip(self.fractional(d), "xyz")])
        return F.transform(F.array(parts), around)

    def mic(self, d: Vector) -> Vector:
        best = F.get(self.nearest(d), F.lit(0))
        return best["x"], best["y"], best["z"]

    def wrap(self, p: Vector) -> Vector:
        return self._cartesian(tuple(f - F.floor(f) for f in self.fractional(p)))  # type: ignore[arg-type]

    def volume(self) -> Column:
        a, b, c = self._rows()
        return F.abs(dot(a, cross(b, c)))

    def mean_length(self) -> Column:
        a, b, c = self._rows()
        return (norm(a) + norm(b) + norm(c)) / 3.0

    def center(self) -> Vector:
        rows = self._rows()
        return tuple((rows[0][k] + rows[1][k] + rows[2][k]) / 2.0 for k in range(3))  # type: ignore[return-value]


class Open(Box):
    """No cell: displacements as they are."""

    columns = ()

    def matrix(self) -> Column:
        return F.array(*[F.array(*[F.lit(0.0)] * 3)] * 3)

    def numbers(self) -> list[Column]:
        return []

    @staticmethod
    def image(d: Sequence[float], cell: Sequence[float]) -> Sequence[float]:
        return d

    def mic(self, d: Vector) -> Vector:
        return d


BOX, CELL = Box(), Cell()


def cell_of(frames: DataFrame) -> Box:
    """The kind of cell that frames need: BOX if they have lengths and no cell, or only cells along the axes; else CELL."""
    if "cell" not in frames.columns:
        return BOX if "lx" in frames.columns else Open()
    slanted = F.exists(F.flatten(F.transform("cell", lambda row, i: F.filter(row, lambda x, k: k != i))), lambda x: x != 0.0)
    return CELL if "lx" not in frames.columns or not frames.filter(slanted).isEmpty() else BOX


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once, however often they are used: they stay behind an inlined array, so the optimizer doesn't write them out in each use."""
    names = [c for c in df.columns if c not in columns]
    return df.select(*names, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def angle(a: Vector, b: Vector) -> Column:
    """The angle between two vectors in degrees; 90 if one is zero, as lengths are padded by 1e-10."""
    c = dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def onto_z(v: Vector, p: Vector) -> Vector:
    """p after the rotation that takes v to +z (Rodrigues): none for a zero or parallel v, a half turn about x for an opposite one."""
    n = norm(v)
    ux, uy, uz = v[0] / n, v[1] / n, v[2] / n
    # axis (uy, -ux, 0), cosine uz
    s2 = ux * ux + uy * uy
    ax, ay = uy, -ux
    along = (ax * p[0] + ay * p[1]) / (1.0 + uz)
    rx = p[0] * uz + ay * p[2] + ax * along
    ry = p[1] * uz - ax * p[2] + ay * along
    rz = p[2] * uz + ax * p[1] - ay * p[0]
    still = (n < 1e-10) | ((s2 < 1e-20) & (uz > 0))
    turned = (s2 < 1e-20) & (uz < 0)

    def pick(same: Column, half: Column, rotated: Column) -> Column:
        return F.when(still, same).when(turned, half).otherwise(rotated)

    return pick(p[0], p[0], rx), pick(p[1], -p[1], ry), pick(p[2], -p[2], rz)


def about_z(p: Vector, phi: Column) -> Vector:
    """p turned by -phi about z."""
    c, s = F.cos(phi), F.sin(phi)
    return p[0] * c + p[1] * s, p[1] * c - p[0] * s, p[2]


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """The number of an equal-width bin, null outside; the last one also holds the upper edge."""
    width = (high - low) / bins
    n = F.floor((value - low) / width).cast("int")
    return F.when((value >= low) & (value <= high), F.least(n, F.lit(bins - 1)))


def edges(stop: float, step: float) -> list[float]:
    """0, step, ... up to the first at stop or beyond, as the reference's grids have it."""
    import numpy as np

    return [float(x) for x in np.arange(0.0, stop + step, step)]
