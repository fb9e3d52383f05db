"""Text helpers for the SQL twins: vectors are triples of expressions."""

from __future__ import annotations


def vec(prefix: str) -> tuple[str, str, str]:
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def sub(a, b):
    return tuple(f"({p} - {q})" for p, q in zip(a, b, strict=True))


def dot(a, b):
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def cross(a, b):
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def norm(a):
    return f"sqrt({dot(a, a)})"


def dist(a, b):
    d = sub(a, b)
    return norm(d)


def dihedral(p1, p2, p3, p4):
    b1, b2, b3 = sub(p2, p1), sub(p3, p2), sub(p4, p3)
    return f"degrees(atan2({norm(b2)} * {dot(b1, cross(b2, b3))}, {dot(cross(b1, b2), cross(b2, b3))}))"


def cos_angle(u, v):
    nn = f"({norm(u)} * {norm(v)})"
    return f"(case when {nn} > 0 then least(1e0, greatest(-1e0, {dot(u, v)} / {nn})) else 0e0 end)"


def shifted(fn: str, prefix: str, out: str, k: int = 1) -> str:
    """lag or lead of a vector as new columns."""
    return ", ".join(f"{fn}({prefix}{c}, {k}) over w as {out}{c}" for c in "xyz")


ALONG = "window w as (partition by ck order by idx)"
