"""Column expressions on points: structs with fields x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | str, y: Column | str, z: Column | str) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def sub(a: Column, b: Column) -> Column:
    """Vector from b to a."""
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    dx, dy, dz = a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def cos_angle(u: Column, v: Column) -> Column:
    """Cosine between two vectors, 0 when one is null length."""
    nn = norm(u) * norm(v)
    return F.when(nn > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(u, v) / nn))).otherwise(F.lit(0.0))


def dihedral(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Torsion p1-p2-p3-p4 in degrees, positive clockwise along p2 to p3."""
    b1, b2, b3 = sub(p2, p1), sub(p3, p2), sub(p4, p3)
    y = norm(b2) * dot(b1, cross(b2, b3))
    return F.degrees(F.atan2(y, dot(cross(b1, b2), cross(b2, b3))))


def mixed(u: Column, v: Column, w: Column) -> Column:
    """Component of w along the unit normal of u and v."""
    n = cross(u, v)
    return F.when(norm(n) > 0, dot(n, w) / norm(n)).otherwise(F.lit(0.0))
