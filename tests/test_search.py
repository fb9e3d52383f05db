"""Searches against brute force on small inputs."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.operators import cuts as CU
from foldframe.operators import merge as M
from foldframe.operators import potential as P
from foldframe.operators import quality as QU


def walk(n, seed):
    rng = np.random.default_rng(seed)
    step = rng.normal(size=(n, 3))
    return np.cumsum(3.8 * step / np.linalg.norm(step, axis=1)[:, None], axis=0)


def probability(xyz):
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    return 1 / (1 + np.exp((d - 6) / 1.5))


def brute_cuts(xyz, ok):
    p, n = probability(xyz), len(xyz)
    ends = n - 1
    single, double = None, None

    def keep(best, a, b, c, i, j):
        den = (a + c) * (b + c)
        s = round((a * b - c * c) / den, 9) if den else -1
        return (s, i, j) if s > 0 and (best is None or s > best[0]) else best

    for i in range(n):
        if i >= 30 and ends - i >= 30 and ok[i + 1]:
            single = keep(single, p[:i + 1, :i + 1].sum(), p[i + 1:, i + 1:].sum(), p[:i + 1, i + 1:].sum(), i, -1)
    for i in range(29, ends - 30):
        for j in range(i + 30, ends - 15 + 1):
            if i + 60 < ends - 15 and ok[i + 1] and ok[j + 1]:
                mid = slice(i + 1, j + 1)
                a = p[mid, mid].sum()
                out = np.r_[0:i + 1, j + 1:n]
                double = keep(double, a, p[np.ix_(out, out)].sum(), p[mid][:, out].sum(), i, j)
    return single, double


@pytest.mark.parametrize(("n", "seed"), [(45, 1), (70, 2), (110, 3), (130, 4)])
def test_cuts_match_brute_force(n, seed, monkeypatch):
    xyz, ok = walk(n, seed), np.random.default_rng(seed).random(n) > 0.2
    want = brute_cuts(xyz, ok)
    for rows in (256, 16):  # one block, then many blocks
        monkeypatch.setattr(CU, "ROWS", rows)
        for got, exp in zip(CU.segment_cuts(xyz, ok), want, strict=True):
            assert (got is None) == (exp is None)
            if got:
                assert got[1:] == exp[1:]
                assert got[0] == pytest.approx(exp[0], abs=2e-9)


def test_levels_tile_the_chain_and_short_chain_stays_whole():
    rows = CU.unit_levels(walk(300, 5), np.ones(300, bool), 30, 64, 0)
    by = {}
    for level, _, s, e, _ in rows:
        by.setdefault(level, []).append((s, e))
    for segs in by.values():
        segs.sort()
        assert segs[0][0] == 0 and segs[-1][1] == 299
        assert all(a[1] + 1 == b[0] for a, b in zip(segs, segs[1:]))
    assert CU.unit_levels(walk(40, 6), np.ones(40, bool), 30, 64, 0) == [(0, 0, 0, 39, 0.0)]


def test_two_blobs_split_in_the_linker():
    t = np.arange(60)
    coil = np.c_[5 * np.cos(t * 1.7), 5 * np.sin(t * 1.7), t * 0.3]
    link = np.linspace(coil[-1], coil[0] + [100, 0, 0], 7)[1:-1]
    xyz = np.vstack([coil, link, coil + [100, 0, 0]])
    single, double = CU.segment_cuts(xyz, np.ones(len(xyz), bool))
    best = CU.best_of(single, double)
    assert any(58 <= c <= 65 for c in best[1:])


def all_partitions(items):
    if not items:
        yield []
        return
    head, rest = items[0], items[1:]
    for sub in all_partitions(rest):
        yield [[head]] + sub
        for k in range(len(sub)):
            yield sub[:k] + [[head] + sub[k]] + sub[k + 1:]


def test_wide_beam_reaches_every_partition(spark):
    n, rng = 5, np.random.default_rng(0)
    m = rng.random((n, n)) * 20 + 5
    m = (m + m.T) / 2
    sums = spark.createDataFrame([("c", i, j, float(m[i, j])) for i in range(n) for j in range(n)], "ck string, a int, b int, s double")
    units = spark.createDataFrame([("c", i, 35 * i, 35 * i + 34) for i in range(n)], "ck string, pu int, start int, end int")
    mat = M.unit_matrix(sums, units)
    got = {tuple(map(tuple, r.doms)) for r in M.merge_beam(mat, beam=10 ** 6).collect()}
    assert got == {tuple(sorted(tuple(sorted(d)) for d in p)) for p in all_partitions(list(range(n)))}
    row = M.partition_measures(spark.createDataFrame([("c", [[0, 1], [2, 3, 4]])], "ck string, doms array<array<int>>"), mat).first()
    a, b = [0, 1], [2, 3, 4]
    ia, ib, ext = m[np.ix_(a, a)].sum() / 2, m[np.ix_(b, b)].sum() / 2, m[np.ix_(a, b)].sum()
    assert row.max_cr == pytest.approx(ext / (70 ** 0.43 * 105 ** 0.43) / ((ext + ia + ib) / 175))
    assert row.min_density == pytest.approx(min(ia / 70, ib / 105)) and row.kappa == pytest.approx((ia / 70 + ib / 105) / 2)


def test_matching_is_optimal():
    rng = np.random.default_rng(3)
    for shape in [(1, 1), (3, 3), (5, 5), (4, 6), (6, 2)]:
        for _ in range(20):
            w = rng.integers(0, 50, shape).astype(float)
            n = max(shape)
            full = np.zeros((n, n))
            full[:shape[0], :shape[1]] = w
            assert QU.best_matching(w) == max(sum(full[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_alternatives_keep_optimum_and_drop_copies(spark):
    sizes = [40, 40, 40, 40]
    units = spark.createDataFrame([("c", i, 40 * i, 40 * i + 39) for i in range(4)], "ck string, pu int, start int, end int")
    strong = np.full((4, 4), 8.0)
    np.fill_diagonal(strong, 300.0)
    sums = spark.createDataFrame([("c", i, j, float(strong[i, j])) for i in range(4) for j in range(4)], "ck string, a int, b int, s double")
    mat = M.unit_matrix(sums, units)
    picked = QU.pick_alternatives(M.partition_measures(M.merge_beam(mat), mat), mat)
    rows = picked.orderBy("alt_id").collect()
    assert [r.alt_id for r in rows] == list(range(len(rows))) and sum(sizes) == 160
    assert rows[0].n == rows[0].n_pred
    assert max(picked.groupBy("n").count().toPandas()["count"]) <= 3


def test_decoys_stop_at_the_identity_bound():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 20, 80)
    seqs = P.shuffled_codes(codes, 50, 0.5, rng)
    same = (seqs == codes).sum(axis=1)
    assert (same <= 40).all() and (same >= 38).all()
    assert all(sorted(s) == sorted(codes) for s in seqs)
    assert P.shuffled_codes(np.zeros(10, int), 5, 0.5, rng) is None


def test_decoy_energy_of_a_permutation():
    rng = np.random.default_rng(2)
    codes, cube = rng.integers(0, 20, 40), rng.random((21, 21, 150))
    l, r = np.triu_indices(40, 4)  # noqa: E741
    k, f = rng.integers(0, 150, len(l)), np.zeros(len(l))
    seqs = P.shuffled_codes(codes, 300, 0.5, np.random.default_rng([1]))
    want = np.array([cube[s[l], s[r], k].sum() for s in seqs])
    assert P.decoy_energies(seqs, l, r, k, f, [cube, cube]) == pytest.approx(want)


def test_ambiguity(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 5, 4, 3, 1)] + [("b", None)], "ck string, quality int")
    assert {r.ck: r.ambiguity for r in QU.ambiguity_index(df).collect()} == {"a": 3}
    z = spark.createDataFrame([(2.0,), (0.9,), (-3.0,)], "z double").select(P.aul_percent(F.col("z")).alias("a"))
    assert [r.a for r in z.collect()] == [75, 0, 88]


def test_carried_contacts_are_the_block_sums(spark):
    """Every partition met while merging carries the sums of its unit blocks, and the beam meets the partitions of a plain search."""
    rng = np.random.default_rng(3)
    rows, sums = [], {}
    for k, n in enumerate((1, 2, 3, 5, 6)):
        s = rng.random((n, n)) * rng.choice([0.02, 3.0], (n, n))
        s = s + s.T + np.diag(rng.random(n) * 40)
        at = np.cumsum(rng.integers(30, 60, n + 1))
        sums[f"c{k}"] = (s, (at[1:] - at[:-1]).tolist())
        rows.append((f"c{k}", n, s.ravel().tolist(), at[:-1].tolist(), (at[1:] - 1).tolist()))
    matrix = spark.createDataFrame(rows, "ck string, npu int, sums array<double>, starts array<int>, ends array<int>")

    def plain(ck, beam):
        s, size = sums[ck]
        live = {tuple((u,) for u in range(len(s)))}
        met = set(live)
        while live:
            tried = []
            for doms in live:
                pairs = []
                for i in range(len(doms)):
                    for j in range(i + 1, len(doms)):
                        a, b = doms[i], doms[j]
                        na, nb = sum(size[u] for u in a), sum(size[u] for u in b)
                        nnc = max(s[np.ix_(a, b)].sum(), 0.001) / (na ** 0.43 * nb ** 0.43)
                        pairs.append((-round(nnc / ((s[np.ix_(a, a)].sum() + s[np.ix_(b, b)].sum()) / 2 / (na * nb)), 9), i, j, nnc))
                pairs.sort()
                tried += [(doms, p) for k, p in enumerate(pairs) if k == 0 or p[3] > 0.01]
            tried.sort(key=lambda t: (-round(t[1][3], 9), t[0], t[1][1], t[1][2]))
            live = {tuple(sorted([d for k, d in enumerate(doms) if k not in (p[1], p[2])] + [tuple(sorted(doms[p[1]] + doms[p[2]]))])) for doms, p in tried[:beam]}
            met |= live
        return met

    for beam in (501, 4):
        found = M.merge_beam(matrix, beam).collect()
        for ck in sums:
            assert {tuple(map(tuple, r.doms)) for r in found if r.ck == ck} == plain(ck, beam)
        for r in found:
            s, size = sums[r.ck]
            assert r.size == [sum(size[u] for u in d) for d in r.doms]
            assert r.inn == pytest.approx([s[np.ix_(d, d)].sum() / 2 for d in r.doms])
            assert r.ext == pytest.approx([s[np.ix_(a, b)].sum() for k, a in enumerate(r.doms) for b in r.doms[k + 1:]])
