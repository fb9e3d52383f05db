"""Exact dedup, Jaccard join and benchmark decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.llm import jaccard_join as J
from foldframe.llm import suffix_decontam as D
from foldframe.llm import work
from foldframe.llm.exact_dedup import drop_exact_copies, exact_groups

ROWS = "doc_id long, text string, keep_id string, id long, n int"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- exact dedup


def test_groups_hold_against_brute_force_and_collisions(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "äBC"), (4, "ÄBC"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (None, "abc"), (None, "lone"), (2, "aBC")]
    docs = frame(spark, [(i, t, "clash", 9, 0) for i, t in rows], ROWS)
    for hashed in (F.md5, lambda c: F.lit("same")):  # every text shares one hash: the bytes decide
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, keep="max", content_hash=hashed).collect()}
        want = set()
        for i, t in rows:
            same = [k for k, u in rows if low(u) == low(t)]
            stay = max((k for k in same if k is not None), default=None)
            want.add((i, stay, len(same), i == stay, hashlib.sha256(low(t).encode()).hexdigest()))
        assert got == want
    assert exact_groups(docs, keep="min").where("kept and doc_id = 1").count() == 1


def test_copies_go_and_columns_stay(spark):
    docs = frame(spark, [(1, "a", "x", 1, 1), (2, "A", "y", 2, 2), (2, "A", "y", 2, 2), (None, None, "z", 3, 3), (None, "", "z", 3, 3)], ROWS)
    left = drop_exact_copies(docs, keep="max")
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), low(r.text)) for r in left.collect()) == [("2", "a"), ("None", "")]
    assert drop_exact_copies(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- Jaccard join


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    comp = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and comp[a] != comp[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {(i, len(s), c) for (i, _), s, c in zip(rows, sets, comp, strict=True)}


def mutated(dice, words, n):
    out = list(words)
    for _ in range(n):
        at = dice.randrange(len(out)) if out else 0
        out[at : at + 1] = dice.choice([[], [f"new{dice.random()}"], [*out[at : at + 1], "extra"]])
    return out


@pytest.mark.parametrize(("k", "num", "block", "common"), [(4, 85, 1024, 1 << 17), (5, 80, 3, 0), (1, 50, 4, 8)])
def test_components_hold_against_brute_force(spark, monkeypatch, k, num, block, common):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "REPORTED_FROM", 3)
    dice = random.Random(k)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for base in range(12):
        words = [f"w{dice.randrange(400)}" for _ in range(dice.choice([1, 3, 5, 6, 8, 9, 10, 40, 150]))]
        for _ in range(dice.randint(1, 6)):
            rows.append(" ".join(mutated(dice, words, dice.choice([0, 0, 1, 2, 5])) + (passage if base % 3 == 0 else [])))
    rows += ["a b c d e f", "a b c d e f g", "a b c d e f g h i", "a b c d e f g h i j", "", None, " \t\n", "one", "ONE", "x " * 40, "x " * 50, "Grün grün", "grün grün"]
    rows = [*enumerate(rows)]
    docs = frame(spark, [(i, t, "c", 1, 1) for i, t in rows], ROWS)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.shingle_components(docs, words=k, num=num).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_join_of_nothing_nulls_and_repeats(spark):
    assert J.shingle_components(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = frame(spark, [(7, text), (7, text), (3, text + " end"), (None, text), (None, "alone here"), (None, None)])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.shingle_components(rows).collect())
    assert got == [("3", 28, "3"), ("7", 27, "3"), ("7", 27, "3"), ("None", 0, "None"), ("None", 1, "None"), ("None", 27, "3")]
    assert sorted(str(r.doc_id) for r in J.drop_near_copies(rows).collect()) == ["3", "None", "None", "None"]


def test_each_text_of_an_id_keeps_its_links(spark):
    """Ids 7 and 9 have two texts each: either text links to another document, and 9's first is also the text of 4."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(n)) for x, n in zip("abcd", (30, 90, 40, 120), strict=True))
    rows = [(7, a), (7, b), (3, a + " end"), (5, b + " end"), (9, c), (9, d), (4, c), (6, d + " end"), (8, "w " * 9), (None, b), (7, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in J.shingle_components(frame(spark, rows)).collect())
    want = [("7", 27, 3), ("7", 87, 3), ("3", 28, 3), ("5", 88, 3), ("9", 37, 4), ("9", 117, 4), ("4", 37, 4), ("6", 118, 4), ("8", 1, 8), ("None", 87, 3), ("7", 0, 7)]
    assert got == sorted(want)


@pytest.mark.parametrize("room", [0, 100, 700, 1 << 20])
def test_common_shingles_are_picked_in_parallel(spark, monkeypatch, room):
    monkeypatch.setattr(J, "COMMON", room)
    texts = [" ".join(f"{k}w{i}" for i in range(500)) for k in range(2)]
    docs = frame(spark, [(i, texts[i % 5 == 0]) for i in range(15)]).coalesce(1)
    found = J.common_shingles(docs, 1, J.Work(spark, "common"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "SinglePartition" not in plan
    n = sorted((r.n for r in found.collect()), reverse=True)
    assert n == ([12] * 500 + [3] * 500)[: len(n)]
    assert len(n) == 1000 if room == 1 << 20 else room * 0.4 <= len(n) <= room


# ---------------------------------------------------------------- decontamination


def brute_matches(docs, items, w=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = {}
    for i, t in docs:
        ws, hit, names = cut(t), set(), set()
        for name, text in items:
            iw = cut(text)
            n = min(w, len(iw))
            windows = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if iw else set()
            for a in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    names.add(str(name))
        out[i] = (len(ws), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_matches_hold_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    monkeypatch.setattr(D, "SHARD_WORDS", 200)
    dice = random.Random(5)
    word = lambda: dice.choice("a b c é Z9".split())
    items = [(1, " ".join(word() for _ in range(20))), (2, "a b"), (3, None), (4, "--"), (10, " ".join(word() for _ in range(13))), (10, "zz yy xx"), (None, "qq, rr")]
    docs = [(k, " ".join([*(word() for _ in range(dice.randint(0, 30))), dice.choice(items)[1] or "", *(word() for _ in range(9))])) for k in range(60)] + [(100, None), (101, ""), (102, items[0][1].upper() + "!" + items[0][1]), (103, "qq.rr " + "a " * 3000)]
    found = D.contamination(D.benchmark_matches(frame(spark, [(i, t, "c", 1, 1) for i, t in docs], ROWS), frame(spark, items, "item_id long, text string")))
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.items)) for r in found.collect()}
    want = brute_matches(docs, [("null" if n is None else n, t) for n, t in items])
    assert got == want
    bad = {i for i, (n, h, _) in want.items() if h and 20 * h >= n}
    assert {r.doc_id for r in found.where("contaminated").collect()} == bad
    kept = D.drop_contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - bad


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_rows_are_judged_each_for_itself(spark, monkeypatch, block):
    """Rows of one id or of none hold different texts; the longest match ties between items of different blocks."""
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    monkeypatch.setattr(D, "SHARD_WORDS", 100)
    one, two = ([f"{c}{i}" for i in range(20)] for c in "ab")
    items = frame(spark, [(k, " ".join(ws)) for k, ws in ((1, one), (2, two), (3, one), (4, ["x", *one[:15]]), (5, one[4:]))], "item_id long, text string")
    assert (len(D.item_blocks(items, "item_id", "text")) > 1) == (block == 60)
    texts = [one, two, [*one, *two], ["clean"] * 400, [*one, "cut", *one[2:]], []]
    docs = [(i, " ".join(t)) for i in (None, None, 7, 8) for t in texts] + [(None, None)]
    whole = D.benchmark_matches(frame(spark, docs), items).collect()
    plain = lambda r: (str(r.doc_id), r.n_words, [(s.start, s.end) for s in r.spans], r.items, r.longest, r.longest_at, r.longest_item)
    i1, i2 = ["1", "3", "4", "5"], ["2"]
    found = [(20, [(0, 20)], i1, 20, 0, "1"), (20, [(0, 20)], i2, 20, 0, "2"), (40, [(0, 40)], sorted(i1 + i2), 20, 0, "1"), (400, [], [], 0, None, None), (39, [(0, 20), (21, 39)], i1, 20, 0, "1"), (0, [], [], 0, None, None)]
    key = lambda r: repr(r)
    assert sorted(map(plain, whole), key=key) == sorted([(str(i), *f) for i in (None, None, 7, 8) for f in found] + [("None", *found[5])], key=key)
    kept = D.drop_contaminated(frame(spark, docs), items).collect()
    assert sorted(map(repr, kept)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in docs if not t or t.startswith("clean"))


def test_longest_match_and_place(spark):
    words = [f"w{i}" for i in range(30)]
    found = D.benchmark_matches(frame(spark, [(1, " ".join(["x", *words[3:25], "y", *words[:15]])), (2, "x y")]), frame(spark, [(5, " ".join(words))], "item_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1].longest, rows[1].longest_at, rows[1].longest_item) == (22, 1, "5")
    assert [(s.start, s.end) for s in rows[1].spans] == [(1, 23), (24, 39)]
    assert rows[2].longest == 0 and rows[2].longest_item is None
    none = frame(spark, [], "item_id long, text string")
    assert D.benchmark_matches(frame(spark, [(1, "a")]), none).first().items == []
    assert D.benchmark_matches(frame(spark, []), none).count() == 0


def test_suffix_array_orders_suffixes():
    import numpy as np

    dice = random.Random(2)
    for _ in range(50):
        codes = [dice.randrange(3) for _ in range(dice.randint(1, 60))]
        assert D.suffix_array(np.array(codes), 64).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:])


def test_a_cell_of_near_copies_returns_fewer_links_than_rows():
    """Copies of one base at and around the limit, where half of all pairs link: exact, joined in the cell, never expanded."""
    dice = random.Random(11)
    cut = J.Shingler(5)
    for changed, joined in ((3, True), (5, None), (9, None), (40, False)):
        base = [f"w{i}" for i in range(160)]
        texts = []
        for k in range(120):
            words = list(base)
            for at in dice.sample(range(160), changed):
                words[at] = f"x{k}-{at}"
            texts.append(" ".join(words))
        sets = [cut(t) for t in texts]
        root = np.arange(len(sets))
        links = J.cell_links(sets, root, np.arange(len(sets)), None, 80, 100)
        assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in links)
        comp = dict(enumerate(range(len(sets))))
        for a in range(len(sets)):
            for b in range(a):
                same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same) and comp[a] != comp[b]:
                    comp = {k: comp[b] if c == comp[a] else c for k, c in comp.items()}
        assert len(links) == len(sets) - len(set(comp.values())) < len(sets)
        assert [len(set(root[[k for k in comp if comp[k] == c]])) for c in set(comp.values())] == [1] * len(set(comp.values()))
        if joined is not None:
            assert bool(links) == joined


def test_only_sets_that_may_link_get_their_texts(spark, monkeypatch):
    """Sets that share a rare shingle without being alike are told apart by their bitmaps: no text of theirs is dealt out, nor kept beside the ids."""
    kept, keep = {}, work.Work.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = (out.count(), out.columns)
        return out

    monkeypatch.setattr(work.Work, "keep", counted)
    monkeypatch.setattr(J, "COMMON", 0)  # shared shingles are not put last
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(30)) + " " + passage) for i in range(12)] + [(50, " ".join(f"u{j}" for j in range(60)))]
    rows.append((51, rows[-1][1] + " end"))
    assert sorted(r.doc_id for r in J.drop_near_copies(frame(spark, rows)).collect()) == [*range(12), 50]
    assert kept["met"][0] > 2 and kept["open"][0] == kept["tile-texts"][0] == 0
    assert kept["star-1-texts"][0] == 2
    assert "bits" not in kept["sets"][1] and "first" not in kept["nodes"][1]


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_small_filter_lets_more_rows_through_and_none_too_few(spark, monkeypatch, bits):
    monkeypatch.setattr(work, "FILTER_BITS", bits)
    rows = spark.range(1000).selectExpr("id", "concat('t', id) as t").union(spark.createDataFrame([(None, "null")], "id long, t string"))
    wanted = rows.where("id % 7 = 0")
    some, others = (sorted(str(r.id) for r in work.among(rows, wanted, "id", "t", out=x).collect()) for x in (False, True))
    assert {str(x) for x in range(0, 1000, 7)} <= set(some) and sorted(some + others) == sorted(str(r.id) for r in rows.collect())
    text = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(7, text), (7, text), (3, text + " end"), (None, text), (8, "else"), (None, None)])
    assert sorted(str(r.doc_id) for r in J.drop_near_copies(docs).collect()) == ["3", "8", "None", "None"]
