"""Steps whose cost at size the findings of the third round name: each case looks at what the earlier code did otherwise."""

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import connect
from pyspark.sql import functions as F

from foldframe.catalog.along import residues
from foldframe.catalog.base import Input
from foldframe.operators import contacts as CT
from foldframe.operators import potential as P
from foldframe.plans.fixtures import spark_view, with_views
from foldframe.session import written
from foldframe.sources import writers as WR

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chain(spark, n, first=0):
    rng = np.random.default_rng(n)
    rows = [("a", first + k, tuple(map(float, p))) for k, p in enumerate(np.cumsum(rng.normal(0, 2.2, (n, 3)), axis=0))]
    return spark.createDataFrame(rows, "ck string, idx int, ca struct<x: double, y: double, z: double>")


def test_written_tables_are_not_broadcast(spark):
    """the size of compressed files says little of the rows, so a written table is not collected on the driver unless it is bounded."""
    rows = spark.range(2000).select(F.col("id"), F.lit("x" * 200).alias("t"))
    left, right = written(rows, "left"), written(rows, "right")
    assert "BroadcastHashJoin" not in plan(left.join(right, "id")) and left.join(right, "id").count() == 2000
    assert "BroadcastHashJoin" in plan(rows.join(written(rows, "small", bounded=True), "id"))


def test_streams_of_a_block_are_scored_together(spark, monkeypatch):
    """a subset's pairs reach Python once for all streams of a block, and the numbers don't depend on how many that are."""
    seq = [(n, "ACDEFGHI"[n % 8]) for n in range(30)]
    res = spark.createDataFrame([("c", n, a) for n, a in seq], "ck string, res_num int, aa string")
    key = lambda a, b: f"{min(a, b)}CA{max(a, b)}CA"
    pairs = spark.createDataFrame([("c", "c", n, m, key(a, b), 0.05 + (n * m) % 5 / 2) for n, a in seq for m, b in seq if m - n > 3], "ckl string, ckr string, numl int, numr int, pair string, d double")
    pot = spark.createDataFrame([(key(a, b), k, float(ord(a) + ord(b) - 7 * k)) for a in "ACDEFGHI" for b in "ACDEFGHI" if a <= b for k in range(6)], "pair string, bin int, e double")
    members = res.select("ck", F.lit("all").alias("subset"), "res_num")
    found = {}
    for at_once in (1, 4):
        monkeypatch.setattr(P, "STREAMS_AT_ONCE", at_once)
        found[at_once] = P.decoy_zscore(P.linear_energy(pairs, pot, 0.5, 6), res, members, pot, n=1200, width=0.5).first()
    assert found[1] == pytest.approx(found[4])


def test_cells_with_blocks_are_not_shuffled(spark):
    """cells that lie by tile are neither shuffled nor sorted for the cumulative sums, over tiles on both sides of the diagonal."""
    cells = CT.contact_probability(chain(spark, 300, 200), blocks=True)
    sums = CT.prefix_sums(cells)
    m = np.zeros((300, 300))
    for r in cells.collect():
        m[r.i - 200, r.j - 200] = m[r.j - 200, r.i - 200] = r.p
    want = m.cumsum(axis=0).cumsum(axis=1)
    got = np.zeros((300, 300))
    for r in sums.collect():
        got[r.i - 200, r.j - 200] = r.c
    assert got == pytest.approx(want)
    by_tile = plan(CT.tile_cells(cells).groupBy("ck", "bi", "bj").applyInArrow(lambda t: pa.table({"n": [t.num_rows]}), "n long"))
    assert by_tile.count("Exchange") == plan(cells.select("*")).count("Exchange")


def test_matrix_text(spark):
    """rows made tile by tile read as those made cell by cell, across blocks and for numbers that are no probabilities."""
    cells = CT.contact_probability(chain(spark, 300), blocks=True)
    text = F.array_sort(F.collect_list(F.struct("j", F.format_string("%7.5f", "p").alias("t"))))
    want = {r.i: " ".join(t.t for t in r.v) for r in CT.mirrored(cells).groupBy("i").agg(text.alias("v")).collect()}
    assert {r.i: r.value for r in WR.contact_matrix_rows(cells, symmetric=True).collect()} == want
    assert {r.i: r.value for r in WR.contact_matrix_rows(CT.mirrored(cells)).collect()} == want
    odd = [0.000005, 0.123455, -0.0, -1e-9, 12.5, 9.999999, 123.4, float("nan"), float("inf"), 1.0, 0.0]
    rows = spark.createDataFrame([("a", i, j, v) for i in range(2) for j, v in enumerate(odd)], "ck string, i int, j int, p double")
    want = " ".join(r.t for r in spark.createDataFrame(list(enumerate(odd)), "k int, p double").select("k", F.format_string("%7.5f", "p").alias("t")).orderBy("k").collect())
    assert [r.value for r in WR.contact_matrix_rows(rows).collect()] == [want, want]
    assert WR.matrix_lines(np.full((1, 2), 0.5), np.array([[True, False]])) == ["0.50000"]


@pytest.mark.parametrize("view", ["fx_atoms", "fx_dirty"])
def test_atom_views_read_residues_once(spark, view):
    """the atom views hold the rows of their SQL and are made from one row per residue."""
    got = spark_view(spark, SF, view)
    cols = sorted(got.columns)
    want = connect(SF).sql(with_views(f"select {', '.join(cols)} from {view}", view)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().analyzed().toString()


def test_box_contacts(spark):
    """pairs in no label together are never made; labels may be broken, nested and far along the chain."""
    res = chain(spark, 600)
    boxes = spark.createDataFrame([("a", "x", 3, 9), ("a", "x", 550, 560), ("a", "y", 250, 262), ("a", "z", 5, 7), ("a", "z", 7, 8)], "ck string, label string, start int, end int")
    want = sorted(map(tuple, CT.contact_tiles(CT.contact_probability(res), boxes).collect()))
    assert sorted(map(tuple, CT.box_contacts(res, boxes).collect())) == want


def test_structure_energy_meets_pairs_once(spark):
    """chain and residue sums read one written table of pair energies."""
    from foldframe.catalog import load

    text = load()[0]["structure_energy"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in text and "InMemoryRelation" not in text and "pair-energies" in load()[0]["structure_energy"](spark, SF).inputFiles()[0]


def test_residues_of_the_plan_are_written(spark):
    """the structured residues, which every step of the plan reads, are a table."""
    from foldframe.plans import decompose as D

    res = D.with_ss(residues(Input(spark, SF)).drop("ss"))
    assert all("structured" in f for f in res.inputFiles())


def test_streams_are_drawn_together():
    """the swaps of all streams are made at once, and each stream's sequences are those it has alone, also with unlike counts."""
    codes = np.random.default_rng(3).integers(0, 20, 40).astype(np.int8)
    rngs = lambda: [np.random.default_rng([7, 5, k]) for k in range(4)]
    alone = [P.shuffled_codes(codes, n, 0.5, rng) for n, rng in zip((50, 50, 1, 20), rngs(), strict=True)]
    assert (P.shuffled_streams(codes, [50, 50, 1, 20], 0.5, rngs()) == np.concatenate(alone)).all()
    assert P.shuffled_streams(np.zeros(10, int), [5, 5], 0.5, rngs()[:2]) is None
