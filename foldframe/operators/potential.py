"""Distance-based statistical potentials: training, scoring and decoy Z-scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe import constants as K
from foldframe.functions.spatial import near_self_pairs
from foldframe.operators.contacts import fragment_sums
from foldframe.session import spread, written

BROADCAST_BYTES = 64 * 1024 * 1024
#: Residue pairs whose energies for all residue types are tabled at a time, so that the table stays in cache.
PAIRS_AT_ONCE = 128
#: Positions of a tile of pairs, decoys of one random stream, and streams scored together.
DECOY_TILE, SEEDS_AT_ONCE, STREAMS_AT_ONCE = 512, 500, 4
LETTERS = sorted(K.ONE_TO_THREE)


def n_bins(dmax: float, width: float) -> int:
    return round(dmax / width)


def pair_distances(atoms: DataFrame, dmax: float = K.POT_MAX, dmin: float = 0.0, smin: int = K.POT_SEP_MIN, smax: int = K.POT_SEP_MAX,
                   inter: bool = True, intra: bool = True) -> DataFrame:
    """Atom pairs with dmin < d < dmax, in one chain with smin < number difference < smax or in two chains of a structure.

    Input: structure_id, chain, ck, res_num, atom_type, x, y, z. The pair key joins the two atom types in alphabetical
    order and the residue ids follow it (equal types are listed later residue first).
    """
    model = ["model"] if "model" in atoms.columns else []
    keys = ["structure_id", *model] if inter else ["structure_id", *model, "chain"]
    gap = F.col("r.res_num") - F.col("l.res_num")
    same = F.col("l.chain") == F.col("r.chain")
    ok = F.lit(False)
    if intra:
        ok = ok | (same & (gap > smin) & (gap < smax))
    if inter:
        ok = ok | ~same
    cols = ["structure_id", *model, "chain", "ck", "res_num", "atom_type", "x", "y", "z"]
    met = near_self_pairs(atoms.select(*cols), keys, ["chain", "res_num", "atom_type"], dmax, ok & (F.col("d") > dmin))
    keep = F.col("l.atom_type") < F.col("r.atom_type")
    a, b = F.when(keep, F.col("l")).otherwise(F.col("r")), F.when(keep, F.col("r")).otherwise(F.col("l"))
    return (met.select("d", F.col("l.structure_id").alias("structure_id"), a.alias("a"), b.alias("b"))
            .select("structure_id", F.concat("a.atom_type", "b.atom_type").alias("pair"), "d", F.col("a.ck").alias("ckl"), F.col("b.ck").alias("ckr"),
                    F.col("a.res_num").alias("numl"), F.col("b.res_num").alias("numr"),
                    F.concat(F.col("a.res_num").cast("string"), "a.chain").alias("resl"), F.concat(F.col("b.res_num").cast("string"), "b.chain").alias("resr")))


def distance_bin(d: Column, width: float = K.POT_BIN) -> Column:
    """0-based bin whose upper limit is the first one at or above d."""
    return (F.ceil(F.round(d / width, 6)) - 1).cast("int")


def distance_histogram(pairs: DataFrame, width: float = K.POT_BIN) -> DataFrame:
    """Counts per pair key and bin; tasks add up before the shuffle."""
    return pairs.groupBy("pair", distance_bin(F.col("d"), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pair_frequencies(histogram: DataFrame, bins: int = 150) -> DataFrame:
    """Share of each bin within its pair, for all bins."""
    whole = histogram.groupBy("pair").agg(F.sum("n").alias("_t"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    spine = whole.select("pair", "_t", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0))
    return spine.select("pair", "bin", n.cast("bigint").alias("n"), (n / F.col("_t")).alias("f"))


def reference_frequencies(histogram: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Share of each bin over all pairs, or an external distribution (bin, f) in its place."""
    if external is not None:
        return external.select("bin", "f")
    by_bin = histogram.groupBy("bin").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(F.lit(0))  # one row per bin at most
    return by_bin.select("bin", (F.col("n") / F.sum("n").over(whole)).alias("f"))


def pseudo_energy(frequencies: DataFrame, reference: DataFrame, cap: float = K.POT_CAP) -> DataFrame:
    """-ln(f / reference) per bin with the cap corrections: pair, bin, e.

    Undefined, infinite and exactly zero values take the cap. Then a lone capped bin between two real ones becomes their
    mean, a real bin followed by two capped ones is capped, and every capped bin after the first real one becomes 0.
    """
    raw = (frequencies.select("pair", "bin", "f").join(reference.select("bin", F.col("f").alias("g")), "bin", "left")
           .withColumn("e", F.when((F.col("g") > 0) & (F.col("f") > 0), -F.log(F.col("f") / F.col("g"))).otherwise(0.0))
           .withColumn("e", F.when(F.col("e") == 0, F.lit(cap)).otherwise(F.col("e"))))
    w = W.partitionBy("pair").orderBy("bin")
    at = lambda k: (F.lag("e", -k) if k < 0 else F.lead("e", k)).over(w)
    capped = lambda c: c == cap
    real = lambda c: c.isNotNull() & (c != cap)
    lone = capped(F.col("e")) & real(at(-1)) & real(at(1))
    lost = real(F.col("e")) & capped(at(1)) & capped(at(2))
    first = raw.select("pair", "bin", F.when(lone, (at(-1) + at(1)) / 2).when(lost, F.lit(cap)).otherwise(F.col("e")).alias("e"))
    seen = F.coalesce(F.bool_or(F.col("e") != cap).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return first.select("pair", "bin", F.when((F.col("e") == cap) & seen, 0.0).otherwise(F.col("e")).alias("e"))


def train(pairs: DataFrame, width: float = K.POT_BIN, dmax: float = K.POT_MAX) -> DataFrame:
    """Potential of a set of pair distances; the small histogram is written once so that the pairs are met only once."""
    h = written(distance_histogram(pairs, width), "histogram", bounded=True)
    return pseudo_energy(pair_frequencies(h, n_bins(dmax, width)), reference_frequencies(h))


def kernel_value(kind: str, u: Column, bw: Column) -> Column:
    """Kernel density of unit mass and standard deviation ``bw`` at offset ``u``."""
    half_width = {"e": 5 ** 0.5, "r": 3 ** 0.5, "t": 6 ** 0.5, "b": 7 ** 0.5, "c": (1 / 3 - 2 / np.pi ** 2) ** -0.5, "o": (1 - 8 / np.pi ** 2) ** -0.5}
    if kind == "g":
        return F.exp(-0.5 * (u / bw) * (u / bw)) / (bw * float(np.sqrt(2 * np.pi)))
    a = bw * float(half_width[kind])
    v = u / a
    shape = {"e": 0.75 * (1 - v * v), "r": F.lit(0.5), "t": 1 - F.abs(v), "b": 0.9375 * (1 - v * v) * (1 - v * v),
             "c": 0.5 * (1 + F.cos(float(np.pi) * v)), "o": float(np.pi / 4) * F.cos(float(np.pi / 2) * v)}[kind]
    return F.when(F.abs(v) < 1, shape / a).otherwise(0.0)


def kde_frequencies(pairs: DataFrame, kernel: str = "g", bandwidth: str = "nrd0", adjust: float = 1.0, cut: float = 3.0,
                    width: float = K.POT_BIN, dmax: float = K.POT_MAX) -> DataFrame:
    """Kernel density at the bin centres per pair, zero where the histogram is empty or beyond cut x bandwidth of the data.

    Distances are first counted at 0.001 resolution and written once, so a frequent pair never brings more rows than the range holds. The
    work is then bounded by pairs x bins x distances, dealt by pair over the session's full width.
    """
    counted = written(pairs.groupBy("pair", F.round("d", 3).alias("x")).agg(F.count(F.lit(1)).alias("n")), "distances")
    stats = counted.groupBy("pair").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.col("x")).alias("sx"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sxx"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("m")) / (F.col("m") - 1)))
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    width_of = F.when(iqr > 0, F.least(F.col("sd"), iqr)).otherwise(F.col("sd"))
    factor = {"nrd0": 0.9, "nrd": 1.06}[bandwidth]
    stats = (stats.where("m > 1").withColumn("sd", sd).withColumn("bw", width_of * factor * adjust * F.pow(F.col("m").cast("double"), F.lit(-0.2))))
    grid = stats.where("bw > 0").select("pair", "m", "bw", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins(dmax, width) - 1))).alias("bin"))
    grid = grid.withColumn("c", (F.col("bin") + 0.5) * width)
    filled = counted.groupBy("pair", distance_bin(F.col("x"), width).alias("bin")).agg(F.sum("n").alias("_k"))
    grid = grid.join(filled, ["pair", "bin"], "left")
    live = F.col("_k").isNotNull() & F.col("c").between(F.col("lo") - cut * F.col("bw"), F.col("hi") + cut * F.col("bw"))
    dens = (spread(grid.where(live).select("pair", "bin", "c", "bw", "m"), "pair").join(spread(counted, "pair"), "pair")
            .groupBy("pair", "bin").agg(F.sum(F.col("n") * kernel_value(kernel, F.col("c") - F.col("x"), F.col("bw")) / F.col("m")).alias("f")))
    return grid.select("pair", "bin").join(dens, ["pair", "bin"], "left").select("pair", "bin", F.coalesce("f", F.lit(0.0)).alias("f"))


def top_distances(pairs: DataFrame, k: int = 100) -> DataFrame:
    """The k shortest pairs."""
    return pairs.orderBy("d", "pair", "structure_id", "resl", "resr").limit(k)


def top_energies(potentials: DataFrame) -> DataFrame:
    """Lowest energy of each pair, lowest first."""
    return potentials.groupBy("pair").agg(F.min("e").alias("e")).orderBy("e", "pair")


def top_occurrences(histogram: DataFrame) -> DataFrame:
    """Pairs by number of observations."""
    return histogram.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair")


def expected_pairs(spark, name: str) -> DataFrame:
    """All unordered atom-type pairs of a representation."""
    types = F.array(*[F.lit(t) for t in K.representation(name)])
    a = spark.range(1).select(F.explode(types).alias("a"))
    return a.select("a", F.explode(types).alias("b")).where("a <= b").select(F.concat("a", "b").alias("pair"))


def missing_pairs(pairs: DataFrame, name: str = "CA") -> DataFrame:
    """Expected pair keys that never occur."""
    return expected_pairs(pairs.sparkSession, name).join(pairs.select("pair").distinct(), "pair", "left_anti")


def energy_rows(potentials: DataFrame) -> DataFrame:
    """One row per pair with its energies as an array in bin order."""
    ordered = F.array_sort(F.collect_list(F.struct("bin", "e")))
    return potentials.groupBy("pair").agg(F.transform(ordered, lambda s: s["e"]).alias("es"))


def small(table: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast hint only when the table's largest possible size is known to be small."""
    return F.broadcast(table) if rows * bytes_per_row <= BROADCAST_BYTES else table


def bin_position(d: Column, width: float, bins: int) -> tuple[Column, Column]:
    """Lower bin centre and fraction towards the next one, clamped to the outer centres."""
    t = F.round((d - width / 2) / width, 9)
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(t).cast("int")))
    frac = F.when((t <= 0) | (t >= bins - 1), 0.0).otherwise(t - k)
    return k, frac


def linear_energy(pairs: DataFrame, potentials: DataFrame, width: float = K.POT_BIN, bins: int = 150, types: int = 20) -> DataFrame:
    """Add ``e``: energy at d by linear interpolation between bin centres; 0 for a pair the potential lacks.

    ``types`` bounds the number of atom types, hence the size of the looked-up table.
    """
    table = small(energy_rows(potentials), types * (types + 1) // 2, 8 * bins)
    k, frac = bin_position(F.col("d"), width, bins)
    at = lambda i: F.get("es", i)
    y0 = at(k)
    y1 = at(F.least(F.lit(bins - 1), k + 1))
    return pairs.join(table, "pair", "left").withColumn("e", F.coalesce(y0 + frac * (y1 - y0), F.lit(0.0))).drop("es")


def spline_table(potentials: DataFrame, width: float = K.POT_BIN) -> DataFrame:
    """Natural cubic spline coefficients per pair and interval: pair, bin, a, b, c, e.

    On [x_k, x_k+1] with h = x - x_k the value is ((a h + b) h + c) h + e; the last row and a row with bin -1 hold the
    quadratic extensions to the right and left.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        y = pdf["e"].to_numpy()
        n = len(y)
        m = np.zeros(n)  # second derivatives, zero at both ends
        if n > 2:
            system = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
            m[1:-1] = np.linalg.solve(system, 6 * (y[2:] - 2 * y[1:-1] + y[:-2]) / width ** 2)
        a = np.append((m[1:] - m[:-1]) / (6 * width), 0.0)
        b = m / 2
        c = np.append((y[1:] - y[:-1]) / width - width * (2 * m[:-1] + m[1:]) / 6, 0.0)
        if n > 1:
            c[-1] = c[-2] + 2 * b[-2] * width + 3 * a[-2] * width ** 2
        rows = pd.DataFrame({"pair": pdf["pair"].iloc[0], "bin": pdf["bin"].to_numpy(), "a": a, "b": b, "c": c, "e": y})
        left = rows.iloc[[0]].assign(bin=-1, a=0.0)
        return pd.concat([left, rows])

    return potentials.select("pair", "bin", "e").groupBy("pair").applyInPandas(fit, "pair string, bin int, a double, b double, c double, e double")


def spline_position(d: Column, width: float, bins: int) -> tuple[Column, Column]:
    """Row of ``spline_table`` (from 0, in bin order) that holds d, and the offset in its interval."""
    t = F.floor(F.round((d - width / 2) / width, 9)).cast("int")
    k = F.greatest(F.lit(-1), F.least(F.lit(bins - 1), t))
    return k + 1, d - (F.greatest(k, F.lit(0)) + 0.5) * width


def cubic_energy(pairs: DataFrame, potentials: DataFrame, width: float = K.POT_BIN, bins: int = 150, types: int = 20) -> DataFrame:
    """Add ``e``: energy at d from the natural cubic spline of its pair; 0 for a pair the potential lacks."""
    co = F.array_sort(F.collect_list(F.struct("bin", "a", "b", "c", "e")))
    table = small(spline_table(potentials, width).groupBy("pair").agg(co.alias("co")), types * (types + 1) // 2, 48 * bins)
    k, h = spline_position(F.col("d"), width, bins)
    joined = pairs.join(table, "pair", "left").withColumn("_s", F.get("co", k))
    value = ((F.col("_s.a") * h + F.col("_s.b")) * h + F.col("_s.c")) * h + F.col("_s.e")
    return joined.withColumn("e", F.coalesce(value, F.lit(0.0))).drop("co", "_s")


def structure_energy(pair_energies: DataFrame) -> DataFrame:
    """Sum of pair energies per chain of the first partner. Input of one-chain pairs gives chain energies."""
    return pair_energies.groupBy(F.col("ckl").alias("ck")).agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n_pairs"))


def residue_energy(pair_energies: DataFrame) -> DataFrame:
    """Sum of pair energies per residue, each pair counting for both ends."""
    ends = F.array(F.struct(F.col("ckl").alias("ck"), F.col("numl").alias("res_num")), F.struct(F.col("ckr").alias("ck"), F.col("numr").alias("res_num")))
    return (pair_energies.select(F.explode(ends).alias("k"), "e").groupBy("k.ck", "k.res_num").agg(F.sum("e").alias("e")))


def runs_of(members: DataFrame) -> DataFrame:
    """Fragments of residue subsets (ck, subset, res_num) as runs of consecutive numbers: ck, subset, start, end."""
    at = members.select("ck", "subset", "res_num").distinct()
    run = F.col("res_num") - F.row_number().over(W.partitionBy("ck", "subset").orderBy("res_num"))
    return at.withColumn("_r", run).groupBy("ck", "subset", "_r").agg(F.min("res_num").alias("start"), F.max("res_num").alias("end")).drop("_r")


def subset_energy(pair_energies: DataFrame, members: DataFrame) -> DataFrame:
    """Energy of residue subsets (ck, subset, res_num): pairs of one chain with both ends inside, to nine digits."""
    return energy_of(chain_pairs(pair_energies), members)


def chain_pairs(pair_energies: DataFrame, *more: Column) -> DataFrame:
    """Pairs of one chain in order of their numbers: ck, i, j, v (the energy)."""
    low, high = F.least("numl", "numr").alias("i"), F.greatest("numl", "numr").alias("j")
    return pair_energies.where("ckl = ckr").select(F.col("ckl").alias("ck"), low, high, F.col("e").alias("v"), *more)


def energy_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Energy of each subset from pairs in the form of ``chain_pairs``, 0 where it has none."""
    sums = fragment_sums(pairs, runs_of(members)).withColumnRenamed("s", "e")
    return members.select("ck", "subset").distinct().join(sums, ["ck", "subset"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))


def bin_count(potentials: DataFrame) -> int:
    """Number of bins of a potential, from its own rows."""
    return int(potentials.agg(F.max("bin")).first()[0] + 1)


def energy_cube(potentials: DataFrame) -> np.ndarray:
    """Potential of a representation with one atom per residue as a 21 x 21 x bins array on the driver, with one zero row and column for
    unknown residues.

    210 pairs at most: a key is residue letter and atom name twice, with the same atom. Any other key is an error, as decoys shuffle
    residues and could not score it.
    """
    last = F.col("pair").rlike("^([A-Z])([A-Z0-9]*)([A-Z])\\2$") & F.substring("pair", 1, 1).isin(*LETTERS)
    atom = F.regexp_extract("pair", "^[A-Z]([A-Z0-9]*)[A-Z]\\1$", 1)
    kinds = potentials.select(F.when(last, atom).alias("atom")).distinct().limit(3).collect()
    if len(kinds) != 1 or kinds[0].atom is None:
        raise ValueError(f"decoys need pairs of one atom per residue, the potential has {[k.atom for k in kinds]}")
    at = 1 + len(kinds[0].atom)
    cube = np.zeros((21, 21, bin_count(potentials)))
    for row in potentials.toLocalIterator():
        i, j = LETTERS.index(row.pair[0]), LETTERS.index(row.pair[at])
        cube[i, j, row.bin] = cube[j, i, row.bin] = row.e
    return cube


def shuffled_codes(codes: np.ndarray, n: int, max_identity: float, rng: np.random.Generator) -> np.ndarray | None:
    """n sequences reached from ``codes`` by random swaps, each stopped once its identity is at most ``max_identity``.

    None when no order of these residues can be that different.
    """
    return shuffled_streams(codes, [n], max_identity, [rng])


def shuffled_streams(codes: np.ndarray, counts: list[int], max_identity: float, rngs: list[np.random.Generator]) -> np.ndarray | None:
    """The sequences of ``shuffled_codes`` for each count and generator, one below the other; their swaps are made together."""
    size = len(codes)
    most = np.bincount(codes).max()
    if size < 2 or max(0, 2 * most - size) > max_identity * size:
        return None
    n = sum(counts)
    seqs = np.tile(codes, (n, 1))
    flat = seqs.reshape(-1)
    same = np.full(n, size)
    base = np.arange(n if size > max_identity * size else 0) * size  # where each unfinished sequence begins
    same, stream, left = same[:len(base)], np.repeat(np.arange(len(counts)), counts)[:len(base)], counts
    while len(base):
        drawn = [(rng.integers(0, size, m), rng.integers(1, size, m)) for rng, m in zip(rngs, left, strict=True) if m]
        i, j = (np.concatenate(x) for x in zip(*drawn, strict=True))
        j += i
        np.subtract(j, size, out=j, where=j >= size)
        own_i, own_j = codes.take(i), codes.take(j)
        i += base
        j += base
        a, b = flat.take(i), flat.take(j)
        same += (b == own_i).view(np.int8) - (a == own_i).view(np.int8) + (a == own_j).view(np.int8) - (b == own_j).view(np.int8)
        flat[i], flat[j] = b, a
        live = same > max_identity * size
        if not live.all():
            base, same, stream = base[live], same[live], stream[live]
            left = np.bincount(stream, minlength=len(counts)).tolist()
    return seqs


def cubic_cubes(potentials: DataFrame, width: float = K.POT_BIN) -> list[np.ndarray]:
    """Spline coefficients, highest power first, in the form of ``energy_cube``; interval 0 extends the spline to the left."""
    split = written(spline_table(potentials, width), "splines", bounded=True)
    return [energy_cube(split.select("pair", (F.col("bin") + 1).alias("bin"), F.col(c).alias("e"))) for c in "abce"]


def linear_cubes(potentials: DataFrame) -> list[np.ndarray]:
    """Rise to the next bin and value of each bin, in the form of ``energy_cube``."""
    cube = energy_cube(potentials)
    return [np.diff(cube, axis=2, append=cube[:, :, -1:]), cube]


def decoy_energies(seqs: np.ndarray, l: np.ndarray, r: np.ndarray, k: np.ndarray, h: np.ndarray, cubes: list[np.ndarray]) -> np.ndarray:  # noqa: E741
    """Energy of each sequence over the residue pairs l, r, each at offset ``h`` in interval ``k`` of the polynomials ``cubes``."""
    by_bin = [np.ascontiguousarray(np.moveaxis(c, 2, 0)).reshape(-1, 441) for c in cubes]  # all pairs of residues of a bin beside each other
    by_position = np.ascontiguousarray(seqs.T, np.int64)
    rows = by_position * 21
    e, place, own_e = np.zeros(len(seqs)), np.empty(len(seqs), np.int64), np.empty(len(seqs))
    for lo in range(0, len(l), PAIRS_AT_ONCE):
        at = slice(lo, lo + PAIRS_AT_ONCE)
        table = by_bin[0][k[at]]
        for bins in by_bin[1:]:
            table = table * h[at, None] + bins[k[at]]
        for own, a, b in zip(table, l[at].tolist(), r[at].tolist(), strict=True):  # one lookup of all decoys per residue pair stays in cache
            np.add(rows[a], by_position[b], place)
            e += own.take(place, out=own_e, mode="clip")  # all places are within, so nothing is clipped
    return e


def decoy_zscore(pair_energies: DataFrame, residues: DataFrame, members: DataFrame, potentials: DataFrame, n: int = 2000,
                 max_identity: float = 0.5, width: float = K.POT_BIN, seed: int = 7, form: str = "linear") -> DataFrame:
    """Energy and Z-score of residue subsets against n sequence-shuffled decoys: ck, subset, e, mean, sd, z.

    ``residues``: ck, res_num, aa; ``members``: ck, subset, res_num; ``pair_energies`` within chains of a representation with one atom per
    residue, scored in the same ``form`` (linear or cubic). z is 0 when the energy is 0; mean, sd and z are null where no order of the
    residues differs enough. A chain's pairs are packed once per tile of positions. The unit of work is one subset, one tile and
    ``STREAMS_AT_ONCE`` streams of ``SEEDS_AT_ONCE`` decoys, each drawn from a seed made of the keys and the stream's number, so a large subset
    runs in many tasks and lost tasks give the same numbers again. Energies of the tiles are added up decoy by decoy, and only their mean and
    deviation cross blocks.
    """
    cubes = {"linear": linear_cubes, "cubic": lambda p: cubic_cubes(p, width)}[form](potentials)
    bins = cubes[-1].shape[2] - (form == "cubic")
    sent = residues.sparkSession.sparkContext.broadcast(cubes)
    if form == "linear":
        k, h = bin_position(F.col("d"), width, bins)
    else:
        k, h = spline_position(F.col("d"), width, bins)
    block = lambda c: F.floor(F.col(c) / DECOY_TILE).cast("int")
    tile = ["ck", "bi", "bj"]
    pairs = written(chain_pairs(pair_energies, k.cast("int").alias("k"), h.cast("double").alias("h")), "decoy-pairs")
    packed = pairs.groupBy("ck", block("i").alias("bi"), block("j").alias("bj")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "k", "h"))).alias("_q"))
    packed = packed.select(*tile, *[F.col(f"_q.{c}").alias(c) for c in "ijkh"])
    known = members.select("ck", "subset", "res_num").distinct().join(residues.select("ck", "res_num", "aa"), ["ck", "res_num"])
    listed = known.groupBy("ck", "subset").agg(F.array_sort(F.collect_list(F.struct("res_num", "aa"))).alias("_m"))
    listed = listed.select("ck", "subset", F.col("_m.res_num").alias("nums"), F.array_join("_m.aa", "").alias("seq"))
    held = F.array_distinct(F.transform("nums", lambda x: F.floor(x / DECOY_TILE).cast("int")))
    seeds = F.sequence(F.lit(0), F.lit((n - 1) // SEEDS_AT_ONCE), F.lit(STREAMS_AT_ONCE))
    asked = listed.withColumn("bi", F.explode(held)).withColumn("bj", F.explode(held)).where("bi <= bj").withColumn("part", F.explode(seeds))
    ready = spread(asked, *tile, "part").join(spread(packed.withColumn("part", F.explode(seeds)), *tile, "part"), [*tile, "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {c: i for i, c in enumerate(LETTERS)}
        cubes = [np.moveaxis(np.ascontiguousarray(np.moveaxis(c, 2, 0)), 0, 2) for c in sent.value]  # laid out by bin once a task
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                nums, i, j = np.asarray(row.nums), np.asarray(row.i), np.asarray(row.j)
                l, r = np.searchsorted(nums, i), np.searchsorted(nums, j)  # noqa: E741
                inside = (nums[np.minimum(l, len(nums) - 1)] == i) & (nums[np.minimum(r, len(nums) - 1)] == j)
                if not inside.any():
                    continue
                codes = np.array([index.get(c, 20) for c in row.seq], np.int8)
                streams = range(row.part, min(row.part + STREAMS_AT_ONCE, -(-n // SEEDS_AT_ONCE)))
                key = zlib.crc32(f"{row.ck}|{row.subset}".encode())
                drawn = shuffled_streams(codes, [min(SEEDS_AT_ONCE, n - k * SEEDS_AT_ONCE) for k in streams], max_identity, [np.random.default_rng([seed, key, k]) for k in streams])
                if drawn is not None:
                    es = decoy_energies(drawn, l[inside], r[inside], np.asarray(row.k)[inside], np.asarray(row.h)[inside], cubes)
                    out.append((row.ck, row.subset, row.part, row.bi, row.bj, es))
            yield pd.DataFrame(out, columns=["ck", "subset", "part", "bi", "bj", "es"])

    drawn = ready.mapInPandas(run, "ck string, subset string, part int, bi int, bj int, es array<double>")
    whole = drawn.groupBy("ck", "subset", "part").agg(F.array_sort(F.collect_list(F.struct("bi", "bj", "es"))).alias("_t"))
    none = F.transform(F.get("_t", F.lit(0))["es"], lambda x: F.lit(0.0))
    summed = F.aggregate("_t", none, lambda total, t: F.zip_with(total, t["es"], lambda x, y: x + y))
    stats = whole.select("ck", "subset", F.explode(summed).alias("e")).groupBy("ck", "subset").agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("sd"))
    rows = energy_of(pairs, members).join(stats, ["ck", "subset"], "left")
    live = F.col("e") != 0
    z = F.when(~live, 0.0).when(F.col("sd") > 0, (F.col("e") - F.col("mean")) / F.col("sd"))
    return rows.select("ck", "subset", "e", F.when(live, F.col("mean")).alias("mean"), F.when(live, F.col("sd")).alias("sd"), z.alias("z"))


def aul_percent(z: Column) -> Column:
    """Share of random structures the Z-score excludes, in whole percent: 100 (1 - 1 / z^2), 0 below |z| = 1."""
    return F.when(F.abs(z) >= 1, ((1 - 1 / (z * z)) * 100).cast("int")).otherwise(F.lit(0))
