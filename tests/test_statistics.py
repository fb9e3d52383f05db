"""Statistics of secondary structure on planted bonds, ladders and states, and as a query."""

from pyspark.sql import functions as F

from foldframe.operators import secondary as SS

LINKED = SS.LADDER + ", head int"


def test_sizes_of_ladders_and_sheets(spark):
    """Ladders joined across a bulge count as one; a lone bridge is no sheet, two that share a residue are one; bonds are one more than bridges in each ladder."""
    rows = [("a", 0, "A", 5, 8, 20, 23, 0), ("a", 1, "A", 10, 12, 16, 18, 0), ("a", 2, "A", 21, 22, 40, 41, 2), ("a", 3, "P", 60, 60, 70, 70, 3),
            ("a", 4, "P", 80, 80, 90, 90, 4), ("a", 5, "A", 90, 90, 99, 99, 5), ("b", 0, "P", 3, 42, 103, 142, 0)]
    linked = spark.createDataFrame(rows, LINKED)
    assert sorted(tuple(r) for r in SS.ladder_sizes(linked).collect()) == [("a", "A", 1), ("a", "A", 2), ("a", "A", 7), ("a", "P", 1), ("a", "P", 1), ("b", "P", 40)]
    assert sorted(tuple(r) for r in SS.sheet_sizes(SS.sheets(linked)).collect()) == [("a", 2), ("a", 2), ("b", 1)]
    res = spark.range(50).select(F.lit("a").alias("ck"), F.col("id").cast("int").alias("idx"))
    assert sorted(tuple(r) for r in SS.bridge_bonds(res, linked).collect()) == [("a", "A", 14, 28.0), ("a", "P", 4, 8.0)]


def test_helices_end_at_breaks(spark):
    states = "  HHHHHHHH  HHHH HHHHH "
    res = spark.createDataFrame([("a", k, int(k >= 6), s) for k, s in enumerate(states)], "ck string, idx int, frag int, ss string")
    assert sorted(r.size for r in SS.helix_sizes(res.drop("ss"), res.drop("frag")).collect()) == [4, 4, 4, 5]


def test_bonds_are_counted_by_acceptor(spark):
    """The two best of each acceptor: a third donor is left out, the third acceptor of a donor is not; weak bonds are none."""
    bonds = [(10, 6, -900), (11, 6, -800), (12, 6, -700), (20, 16, -900), (20, 17, -800), (20, 25, -700), (30, 2, -900), (40, 36, -400)]
    rk = lambda b, k: 1 + sum(x[k] == b[k] and x[2] < b[2] for x in bonds)
    ranked = spark.createDataFrame([("a", *b, rk(b, 0), rk(b, 1)) for b in bonds], "ck string, donor int, acceptor int, e int, rk int, ark int")
    res = spark.range(50).select(F.lit("a").alias("ck"))
    assert [tuple(r) for r in SS.hbond_totals(res, ranked).collect()] == [("a", 6, 12.0)]
    assert sorted(tuple(r) for r in SS.hbond_offsets(res, ranked).collect()) == [("a", -5, 1, 2.0), ("a", 3, 1, 2.0), ("a", 4, 2, 4.0), ("a", 5, 1, 2.0)]


def test_query_has_all_parts_from_coordinates(spark):
    from __spark_entry__ import queries

    kinds = {r.kind for r in queries()["ss_statistics"](spark, "/root/testdata/sf0.01").select("kind").distinct().collect()}
    assert kinds >= {"hbond", "hbonds", "bridge_P", "bridge_A", "ladder_P", "ladder_A", "sheet"}
