"""Cumulative sums, energies of nested residue sets and decoys against brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.operators import contacts as CT
from foldframe.operators import potential as P

WIDTH = 0.5


@pytest.mark.parametrize("symmetric", [True, False])
def test_prefix_sums_over_tiles(spark, symmetric):
    """Several tiles a side, a last one that is not full, two chains, numbering from 0 and from 3."""
    rng = np.random.default_rng(3)
    full = {}
    for ck, n, first in (("a", 11, 0), ("b", 5, 3)):
        m = rng.random((n, n))
        full[ck] = (first, (m + m.T) / 2 if symmetric else m)
    rows = [(ck, first + i, first + j, float(m[i, j])) for ck, (first, m) in full.items() for i in range(len(m)) for j in range(i if symmetric else 0, len(m))]
    got = CT.prefix_sums(spark.createDataFrame(rows, "ck string, i int, j int, p double"), symmetric, tile=4).collect()
    assert len(got) == 11 * 11 + 5 * 5
    for r in got:
        first, m = full[r.ck]
        assert r.c == pytest.approx(m[: r.i - first + 1, : r.j - first + 1].sum())


def scored_chain(spark, ck, seq, seed, form="linear"):
    """Residues, pair energies and potential of a chain with random distances between all pairs more than three numbers apart."""
    rng = np.random.default_rng(seed)
    residues = spark.createDataFrame([(ck, n, a) for n, a in seq], "ck string, res_num int, aa string")
    name = lambda a, b: f"{min(a, b)}CA{max(a, b)}CA"
    pairs = [(ck, ck, *((n, m) if rng.random() < 0.5 else (m, n)), name(a, b), float(rng.uniform(0.1, 6))) for n, a in seq for m, b in seq if m - n > 3]
    kinds = sorted({name(a, b) for _, a in seq for _, b in seq})
    potentials = spark.createDataFrame([(k, b, float(rng.normal())) for k in kinds for b in range(12)], "pair string, bin int, e double")
    df = spark.createDataFrame(pairs, "ckl string, ckr string, numl int, numr int, pair string, d double")
    score = {"linear": P.linear_energy, "cubic": P.cubic_energy}[form]
    return residues, df, score(df, potentials, WIDTH, 12), potentials


def test_subset_energy_of_nested_and_broken_sets(spark):
    seq = [(n, "ACDEF"[n % 5]) for n in [*range(-300, -290), *range(5, 40), *range(250, 280), *range(520, 530)]]
    residues, _, scored, _ = scored_chain(spark, "c", seq, 5)
    sets = {"all": [n for n, _ in seq], "left": [n for n, _ in seq if n < 20], "broken": [*range(8, 12), *range(30, 36), *range(255, 270), 525],
            "nested": [*range(9, 11), *range(255, 262)], "one": [7], "edge": [-300, 529]}
    members = spark.createDataFrame([("c", s, n) for s, ns in sets.items() for n in ns] * 2, "ck string, subset string, res_num int")
    got = {r.subset: r.e for r in P.subset_energy(scored, members).collect()}
    energies = [(r.numl, r.numr, r.e) for r in scored.collect()]
    assert got.keys() == sets.keys() and got["one"] == 0
    for s, ns in sets.items():
        assert got[s] == pytest.approx(sum(e for i, j, e in energies if i in ns and j in ns), abs=1e-8)


def test_no_set_and_no_pair(spark):
    residues, _, scored, _ = scored_chain(spark, "c", [(1, "A"), (9, "C")], 5)
    members = spark.createDataFrame([("c", "x", 1), ("d", "y", 1)], "ck string, subset string, res_num int")
    assert P.subset_energy(scored, members.where("false")).count() == 0
    assert sorted(map(tuple, P.subset_energy(scored.where("false"), members).collect())) == [("c", "x", 0.0), ("d", "y", 0.0)]


@pytest.mark.parametrize("form", ["linear", "cubic"])
def test_decoys_against_all_orders(spark, form, monkeypatch):
    """One swap of three different residues ends the shuffling, so decoys are the three swaps alike: mean and deviation are theirs. Numbers far
    apart lie in several tiles, whose energies must belong to the same decoy."""
    monkeypatch.setattr(P, "DECOY_TILE", 16)
    seq = [(1, "A"), (30, "C"), (70, "D"), (75, "E"), (90, "E")]
    residues, pairs, scored, potentials = scored_chain(spark, "c", seq, 8, form)
    sets = {"three": [1, 30, 70], "same": [75, 90], "one": [1]}
    members = spark.createDataFrame([("c", s, n) for s, ns in sets.items() for n in ns], "ck string, subset string, res_num int")
    got = {r.subset: r for r in P.decoy_zscore(scored, residues, members, potentials, n=3000, width=WIDTH, form=form).collect()}
    letters = dict(seq)
    score = {"linear": P.linear_energy, "cubic": P.cubic_energy}[form]
    d = {frozenset((r.numl, r.numr)): r.d for r in pairs.collect()}
    asked, orders = [], [o for o in permutations((0, 1, 2)) if sum(a == b for a, b in enumerate(o)) == 1]
    for k, order in enumerate(orders):
        new = {n: letters[sets["three"][order[at]]] for at, n in enumerate(sets["three"])}
        asked += [(k, "".join(f"{x}CA" for x in sorted((new[n], new[m]))), d[frozenset((n, m))]) for n, m in ((1, 30), (1, 70), (30, 70))]
    sums = score(spark.createDataFrame(asked, "k int, pair string, d double"), potentials, WIDTH, 12).groupBy("k").agg(F.sum("e").alias("e"))
    want = np.array([r.e for r in sums.collect()])
    three = got["three"]
    assert abs(three.mean - want.mean()) < 5 * want.std() / 3000 ** 0.5 and three.sd == pytest.approx(want.std(), rel=0.1)
    assert three.z == pytest.approx((three.e - three.mean) / three.sd)
    assert got["one"].e == 0 and got["one"].z == 0 and got["one"].mean is None
    assert got["same"].e != 0 and got["same"].z is None
