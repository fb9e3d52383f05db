"""Neighbour joins: residue tiles for complete pair tables and grid cells for pairs within a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.session import spread

TILE = 256


def tiled_pairs(rows: DataFrame, keys: list[str], order: str, tile: int = TILE, blocks: bool = False) -> DataFrame:
    """All pairs l, r of one group with l.order <= r.order, as structs ``l`` and ``r``.

    Rows are keyed by blocks of ``tile`` positions and joined block against block, so the largest unit of work is
    tile x tile pairs however long the group is. The number of blocks comes from the group's length alone. With ``blocks`` a pair keeps the
    blocks of both sides (bi, bj), by which the rows are dealt: grouping by keys and blocks needs no further shuffle.
    """
    spans = rows.groupBy(*keys).agg(F.max(order).alias("_last"))
    based = rows.join(spans, keys).withColumn("_b", F.floor(F.col(order) / tile).cast("int"))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    last = F.floor(F.col("_last") / tile).cast("int")
    left = based.select(*keys, F.col("_b").alias("_bl"), F.explode(F.sequence(F.col("_b"), last)).alias("_br"), whole.alias("l"))
    right = based.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_bl"), F.col("_b").alias("_br"), whole.alias("r"))
    on = [*keys, "_bl", "_br"]
    return (spread(left, *on).join(spread(right, *on), on).where(F.col(f"l.{order}") <= F.col(f"r.{order}"))
            .select(*keys, "l", "r", *([F.col("_bl").alias("bi"), F.col("_br").alias("bj")] if blocks else [])))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float, on: Column) -> DataFrame:
    """Pairs l, r of one group whose points (columns x, y, z) lie within ``radius``, filtered by ``on``.

    Points fall in cubic cells of side ``radius``; the left side, which should be the smaller one, is repeated into its 27 neighbouring cells,
    so the join is an equi-join on (group, cell) and never meets pairs further apart than two cells. ``on`` may use l and r.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    shift = F.sequence(F.lit(-1), F.lit(1))
    a = left.select(*keys, F.struct(*[F.col(c) for c in left.columns]).alias("l"),
                    cell("x").alias("_hx"), cell("y").alias("_hy"), cell("z").alias("_hz"))
    a = (a.withColumn("_dx", F.explode(shift)).withColumn("_dy", F.explode(shift)).withColumn("_dz", F.explode(shift))
         .select(*keys, "l", (F.col("_hx") + F.col("_dx")).alias("_gx"), (F.col("_hy") + F.col("_dy")).alias("_gy"),
                 (F.col("_hz") + F.col("_dz")).alias("_gz")))
    b = right.select(*keys, F.struct(*[F.col(c) for c in right.columns]).alias("r"),
                     cell("x").alias("_gx"), cell("y").alias("_gy"), cell("z").alias("_gz"))
    cells = [*keys, "_gx", "_gy", "_gz"]
    dx, dy, dz = [F.col(f"l.{c}") - F.col(f"r.{c}") for c in "xyz"]
    met = spread(a, *cells).join(spread(b, *cells), cells).where(F.sqrt(dx * dx + dy * dy + dz * dz) <= radius)
    # a generator keeps Spark from copying the parts of l and r into ``on`` and pushing that into the join
    return met.select(F.explode(F.array(F.struct(*keys, "l", "r"))).alias("_p")).select("_p.*").where(on)


HALF_SHELL = [(0, 0, 0)] + [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]


def near_self_pairs(rows: DataFrame, keys: list[str], order: list[str], radius: float, on: Column) -> DataFrame:
    """Unordered pairs of one group within ``radius``, each met once, with ``l`` before ``r`` in ``order``.

    Half of the neighbouring cells suffice for a self-join: the right side is repeated into its own cell and thirteen
    others. ``on`` may use d (the distance), l and r.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    whole = F.struct(*[F.col(c) for c in rows.columns])
    a = rows.select(*keys, whole.alias("a"), cell("x").alias("_gx"), cell("y").alias("_gy"), cell("z").alias("_gz"))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in HALF_SHELL])
    b = rows.select(*keys, whole.alias("b"), F.explode(steps).alias("_s"))
    cell_b = lambda c: F.floor(F.col(f"b.{c}") / radius).cast("int")
    b = b.select(*keys, "b", ((F.col("_s.x") == 0) & (F.col("_s.y") == 0) & (F.col("_s.z") == 0)).alias("_same"),
                 *[(cell_b(c) + F.col(f"_s.{c}")).alias(f"_g{c}") for c in "xyz"])
    before = F.struct(*[F.col(f"a.{c}") for c in order]) < F.struct(*[F.col(f"b.{c}") for c in order])
    dx, dy, dz = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"]
    cells = [*keys, "_gx", "_gy", "_gz"]
    met = (spread(a, *cells).join(spread(b, *cells), cells).where(~F.col("_same") | before)
           .withColumn("d", F.sqrt(dx * dx + dy * dy + dz * dz)).where(F.col("d") < radius))
    pair = F.struct(*keys, "d", F.when(before, F.col("a")).otherwise(F.col("b")).alias("l"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("r"))
    # a generator keeps Spark from copying the choice of l and r into every later condition, which it would otherwise push into the join
    return met.select(F.explode(F.array(pair)).alias("_p")).select("_p.*").where(on)
