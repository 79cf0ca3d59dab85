"""Vector arithmetic on arrays of double, inside code generation's reach: no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.binding import let


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))


def zip3(a: Column, b: Column, c: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    return F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), c, lambda p, z: f(p["x"], p["y"], z))


def trans_e(h: Column, r: Column, t: Column, p: int = 2) -> Column:
    """Distance of h + r from t."""
    gap = zip3(h, r, t, lambda x, y, z: x + y - z)
    return total(F.transform(gap, F.abs)) if p == 1 else F.sqrt(total(F.transform(gap, lambda x: x * x)))


def dist_mult(h: Column, r: Column, t: Column) -> Column:
    return -total(zip3(h, r, t, lambda x, y, z: x * y * z))


def halves(v: Column) -> tuple[Column, Column]:
    """The real and the imaginary half of a vector."""
    n = (F.size(v) / 2).cast("int")
    return F.slice(v, 1, n), F.slice(v, n + 1, n)


def compl_ex(h: Column, r: Column, t: Column) -> Column:
    (hr, hi), (rr, ri), (tr, ti) = halves(h), halves(r), halves(t)
    product = lambda a, b, c: total(zip3(a, b, c, lambda x, y, z: x * y * z))
    return -(product(hr, rr, tr) + product(hr, ri, ti) + product(hi, rr, ti) - product(hi, ri, tr))


def rotat_e(h: Column, phase: Column, t: Column) -> Column:
    """Sum of the distances of the rotated head from the tail in each complex coordinate."""
    (hr, hi), (tr, ti) = halves(h), halves(t)
    head = F.zip_with(hr, hi, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    tail = F.zip_with(tr, ti, lambda x, y: F.struct(x.alias("a"), y.alias("b")))

    def gap(p: Column, z: Column, q: Column) -> Column:
        real = p["a"] * F.cos(z) - p["b"] * F.sin(z) - q["a"]
        imaginary = p["a"] * F.sin(z) + p["b"] * F.cos(z) - q["b"]
        return F.sqrt(real * real + imaginary * imaginary + F.lit(1e-8))

    return total(zip3(head, phase, tail, gap))


def clamped(v: Column) -> Column:
    """v with coordinates from -1 to 1, then scaled to length 1 if it is longer."""
    inside = F.transform(v, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))

    def scaled(w: Column) -> Column:
        return let(F.greatest(norm(w), F.lit(1.0)), lambda length: F.transform(w, lambda x: x / length))

    return let(inside, scaled)


def mean_pool(rows: Column, width: int) -> Column:
    """The mean of an array of vectors, coordinate by coordinate."""
    zeros = F.array_repeat(F.lit(0.0), width)
    added = F.aggregate(rows, zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(added, lambda x: x / F.greatest(F.size(rows), F.lit(1)))


def max_pool(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(None).cast("array<double>"), lambda acc, v: F.when(acc.isNull(), v).otherwise(F.zip_with(acc, v, lambda x, y: F.greatest(x, y))))


def padded(v: Column, width: int, fill: Column) -> Column:
    """The first `width` entries, filled up; and a mask of the real ones."""
    kept = F.slice(v, 1, width)
    gap = F.array_repeat(fill, F.lit(width) - F.size(kept))
    mask = F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.lit(width) - F.size(kept)))
    return F.struct(F.concat(kept, gap).alias("ids"), mask.alias("mask"))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")
