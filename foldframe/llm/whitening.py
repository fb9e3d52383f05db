"""Embedding whitening: weighted covariance over distinct vectors, each distinct vector whitened once and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.work import Work

SCALE, SHIFT = 1024, 100_000
#: Scaled entries are held within this bound (beyond it doubles no longer hold whole numbers).
LARGEST = 2.0**53
#: Components kept by default.
COMPONENTS = 8
#: Rows of a matrix that one product takes.
AT_ONCE = 4096
#: A vector whose share of the rows is at least 1/SHARE is dealt over several join keys; there can be at most SHARE of them.
SHARE = 1024


def unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Packed vectors as rows of whole numbers."""
    return np.stack([np.frombuffer(b, np.int32 if len(b) == 4 * dim else np.int64) for b in column.to_pylist()]).astype(np.int64)


def scaled(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (id, v) to (id, dim, x): x holds floor(SCALE * c) + SHIFT of every entry, in 4 bytes each where they fit, else in 8."""
    v = part.column("v")
    ids, dims, packed = [], [], []
    rows = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    starts, ends = (np.asarray(v.offsets)[:-1], np.asarray(v.offsets)[1:])
    entries = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    for i in rows:
        c = entries[starts[i] : ends[i]]
        if not len(c) or not np.isfinite(c).all():
            continue
        x = np.clip(np.floor(c * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
        ids.append(i)
        dims.append(len(x))
        packed.append((x.astype(np.int32) if abs(x).max() < 2**31 else x).tobytes())
    return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(ids, pa.int64())), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "x"])


def in_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over slices of at most AT_ONCE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                out = fn(batch.slice(at, AT_ONCE))
                if out is not None and out.num_rows:
                    yield out

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S)^2 for each row.

    With c = round(S / n), y = x - c and r = S - n * c this is n^2 * sum(y^2) - 2 * n * sum(y * r) + sum(r^2); the inner sums stay in
    64 bits where y and n allow it, else Python's whole numbers take over.
    """
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    big = max(map(abs, centre), default=0) >= 2**62
    y = x.astype(object) - np.array(centre, object) if big else x - np.array(centre, np.int64)
    top, width = max(1, int(abs(y).max())) if y.size else 1, len(sums)
    r = np.array(rest, object)
    if not big and width * top * max(top, max(map(abs, rest), default=0)) < 2**62:
        r = r.astype(np.int64)
    else:
        y = y.astype(object)
    squares, mixed, last = (y * y).sum(1), (y * r).sum(1), sum(v * v for v in rest)
    return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True)]


def summed(rows: DataFrame) -> list[list[float]]:
    """Sum of rows (i, v array<double>) by i and place, as a matrix: tasks send one row per i, the sums come back."""
    places = rows.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((r.i for r in places), default=-1), 1 + max((r.j for r in places), default=-1)))
    for r in places:
        out[r.i, r.j] = r.v
    return out


def weighted_products(vectors: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over rows of weight * y * y^T for y = centred(row), one matrix product per slice, added up inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                y = centred(part)
                one = (y * part.column("weight").to_numpy()[:, None]).T @ y
                held = one if held is None else held + one
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], ["i", "v"])

    return summed(vectors.mapInArrow(run, "i int, v array<double>"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weighted: bool = True) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers x = floor(1024 * c) + 100000. Equal x-vectors are one distinct vector; it weighs as often as it
    occurs, or once with ``weighted=False`` (then the fit list is the distinct vectors). The covariance is centred before it is
    multiplied, divisor the weight's sum n. A component is a unit eigenvector, numbered by falling eigenvalue e; ``whitened`` is the centred
    vector's projection over sqrt(e), ``explained`` e over the trace, ``deviation`` (decimal, exact) the sum over dimensions of
    (n * x - S)^2, ``identity_error`` the largest absolute entry of the whitened covariance minus the identity.

    Vectors that are null or empty or hold null or non-finite entries are left out, as are vectors of another length than the
    commonest (the smaller one of equally common ones). Scaled entries are held within 2^53. Components without variance
    (eigenvalue below d * 2^-52 of the largest) do not exist, so equal vectors only, or one vector, give no rows, as does an empty
    table. A deviation beyond 38 digits is null. Ids may be null or repeated; each row is whitened.

    Only sums (d and d x d numbers) reach the driver. The join back salts vectors that hold 1/1024 of the rows or more, at most
    1024 of them, so no task gets a hot vector whole.
    """
    spark = vectors.sparkSession
    work = Work(spark, "whitening")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()
    keyed = rows.mapInArrow(in_batches(scaled), f"id {id_type}, dim int, x binary")
    distinct = work.keep(keyed.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    out = f"{id_col} {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = distinct.groupBy("dim").agg(F.sum("copies").alias("k")).orderBy(F.desc("k"), "dim").first()
    if common is None:
        return spark.createDataFrame([], out)
    dim, rows_n = common.dim, common.k
    kept = distinct.where(F.col("dim") == dim).withColumn("weight", F.col("copies") if weighted else F.lit(1).cast("long"))

    def totals(part: pa.RecordBatch) -> pa.RecordBatch:
        x, w = unpack(part.column("x"), dim), part.column("weight").to_numpy()
        safe = abs(x).max() < 2**62 // max(1, int(w.sum()))
        sums = (x * w[:, None]).sum(0) if safe else (x.astype(object) * w[:, None]).sum(0)
        return pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), pa.array([int(w.sum())] * dim)], ["i", "s", "w"])

    told = kept.mapInArrow(in_batches(totals), "i int, s decimal(38,0), w long").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("w").alias("w")).orderBy("i").collect()
    n, sums = told[0].w, [int(r.s) for r in told]
    whole = [(2 * s + n) // (2 * n) for s in sums]  # nearest whole number to the mean; what is left of the mean is below one half
    near, rest = np.array(whole, np.int64), np.array([(s - n * c) / n for s, c in zip(sums, whole, strict=True)])
    centred = lambda part: (unpack(part.column("x"), dim) - near) - rest

    cov = weighted_products(kept.select("x", "weight"), centred) / n
    values, basis = np.linalg.eigh((cov + cov.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    real = int((values > max(values[0], 0.0) * dim * 2.0**-52).sum()) if values[0] > 0 else 0
    k = min(components, real)
    if not k:
        return spark.createDataFrame([], out)
    turn, explained = basis[:, :k] / np.sqrt(values[:k]), (values[:k] / np.trace(cov)).tolist()

    def turned(part: pa.RecordBatch) -> pa.RecordBatch:
        white = centred(part) @ turn
        dev = [Decimal(d) if d < 10**38 else None for d in deviations(unpack(part.column("x"), dim), n, sums)]
        cols = [part.column("x"), part.column("copies"), part.column("weight"), pa.array(dev, pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, ["x", "copies", "weight", "deviation", "white"])

    white = work.keep(kept.select("x", "copies", "weight").mapInArrow(in_batches(turned), "x binary, copies long, weight long, deviation decimal(38,0), white array<double>"), "white")
    matrix = lambda part: np.stack(part.column("white").to_numpy(zero_copy_only=False))
    mean = summed(white.select(F.lit(0).alias("i"), F.transform("white", lambda v: v * F.col("weight")).alias("v")))[0] / n
    unit = weighted_products(white.select("white", "weight"), lambda part: matrix(part) - mean) / n
    error = float(abs(unit - np.eye(k)).max())

    # Hot vectors, at most SHARE by their share of the rows, are laid out in several copies and their rows dealt over these.
    hot = white.where(F.col("copies") * SHARE >= rows_n).select("x", F.ceil(F.col("copies") * SHARE / F.lit(rows_n)).cast("int").alias("parts"))
    dealt = keyed.where(F.col("dim") == dim).join(F.broadcast(hot), "x", "left").withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), "parts"), F.lit(0)).cast("int"))
    parts = F.greatest(F.lit(1), F.when(F.col("copies") * SHARE >= rows_n, F.ceil(F.col("copies") * SHARE / F.lit(rows_n))).otherwise(1).cast("int"))
    laid = white.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select("x", "salt", "deviation", "white")
    joined = dealt.select("id", "x", "salt").join(laid, ["x", "salt"]).select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return joined.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                         F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
