"""Re-Pair shards, whitening and collocations against brute force."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.llm import collocations as C
from foldframe.llm import repair_shards as R
from foldframe.llm import whitening as WH
from foldframe.llm.queries import model_file

TOKENIZER = model_file("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, part string, ids string"


# ---------------------------------------------------------------- Re-Pair shards


def plain(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_chunks_give_the_librarys_ids(lib):
    dice = random.Random(4)
    bits = ["a", "Be", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "12", ".", ",", "!?", "<|endoftext|>", " ", "　", "中文", "😀", "́", "_", "can't", "\x1f", "\x85", "\r\n", "ǅ", "ʰ", "²", "word", "Ⱥ"]
    texts = ["".join(dice.choice(bits) for _ in range(dice.randrange(30))) for _ in range(4000)] + ["", " ", "\n", "x" * 30_000, ("long words of text.\nAnd lines " * 20_000)]
    encode = R.encoder(TOKENIZER)
    for at in range(0, len(texts), 500):
        got = encode(texts[at : at + 500])
        assert [np.frombuffer(b, encode.width).tolist() for b in got] == [plain(lib, t)[:-1] for t in texts[at : at + 500]]


@pytest.mark.parametrize("least", [2, 3, 10])
def test_grammar_round_trip_from_any_place(least):
    dice = np.random.default_rng(least)
    for ids in (np.zeros(0), np.array([7]), np.zeros(1000), np.tile([1, 2, 3, 1, 2], 300), dice.integers(0, 5, 5000), dice.integers(0, 40_000, 3000), np.repeat(dice.integers(0, 9, 700), 3)):
        ids = ids.astype(np.uint16)
        shard = R.Shard(R.Shard.pack(ids, [len(ids)], 50_257, 11, least))
        assert shard.first == 11 and shard.decode().tolist() == ids.tolist()
        assert [len(shard.expand(np.array([50_257 + k]))) for k in range(len(shard.rules))] == shard.lengths.tolist()
        for _ in range(20):
            a, n = int(dice.integers(0, len(ids) + 2)), int(dice.integers(0, 60))
            assert shard.decode(a, n).tolist() == ids[a : a + n].tolist()
        left = Counter(zip(shard.symbols[:-1].tolist(), shard.symbols[1:].tolist(), strict=True))
        assert max((n for (a, b), n in left.items() if a != b), default=0) < least
    assert len(R.compress(np.tile([1, 2, 3, 4], 500), 50_257, 2)[1]) < 50


def test_rules_end_where_symbols_are_full():
    ids = np.random.default_rng(1).integers(0, 6, 4000).astype(np.uint32)
    rules, symbols = R.compress(ids, (1 << 16) - 3, 2)
    assert len(rules) == 3 and symbols.max() < 1 << 16


def test_a_damaged_shard_is_told():
    blob = bytearray(R.Shard.pack(np.arange(50, dtype=np.uint16), [50], 50_257, 0))
    blob[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        R.Shard(bytes(blob))


def test_documents_come_back_in_order(spark, tmp_path, lib):
    dice = random.Random(2)
    texts = [" ".join(dice.choice("the of shard grammar Wort été 17".split()) for _ in range(dice.randrange(60))) for _ in range(150)]
    rows = [(k * 7 % 151, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, "x y " * 40_000), *[(600, "a hot id " + str(k % 5)) for k in range(200)], (None, "no id"), (None, "none")]
    docs = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in rows], DOCS).repartition(5)
    got = [tuple(r) for r in R.sharded_ids(docs, TOKENIZER, shard_ids=3000, least=3).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(x := plain(lib, t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert Counter((g[0], g[2], g[3]) for g in got) == want
    assert [g[1] for g in got] == np.concatenate(([0], np.cumsum([g[2] for g in got])[:-1])).tolist()
    R.write_shards(docs, str(tmp_path / "t"), TOKENIZER, shard_ids=3000)
    assert spark.read.parquet(str(tmp_path / "t")).where("n_ids > 3000 and size(ids) > 1").count() == 0
    assert R.sharded_ids(docs.limit(0), TOKENIZER).count() == 0


# ---------------------------------------------------------------- whitening

VECS = "vec_id long, embedding array<float>, x string, component int"


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 1) for i, v in rows], VECS)


def test_whitening_against_numpy(spark):
    dice = np.random.default_rng(5)
    base = dice.normal(0, 0.2, (60, 6)) @ dice.normal(0, 1, (6, 6))
    rows = [(k, base[k % 60].astype(np.float32)) for k in range(90)] + [(1000 + k, base[3].astype(np.float32)) for k in range(60)]  # a hot vector
    bad = [(-1, None), (-2, []), (-3, [1, 2, None, 4, 5, 6]), (-4, [1, 2, float("nan"), 4, 5, 6]), (-5, [float("inf")] * 6), (-6, [1, 2, 3])]
    for weighted in (True, False):
        got = WH.whiten(vec_frame(spark, rows + bad), components=4, weighted=weighted).toPandas()
        x = np.stack([np.floor(v.astype(float) * 1024) + 100_000 for _, v in rows])
        fit = x if weighted else np.unique(x, axis=0)
        n, mean = len(fit), fit.mean(0)
        cov = (fit - mean).T @ (fit - mean) / n
        e, b = np.linalg.eigh(cov)
        e, b = e[::-1], b[:, ::-1]
        assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
        for k in range(4):
            part = got[got.component == k + 1].set_index("vec_id").loc[[i for i, _ in rows]]
            want = (x - mean) @ b[:, k] / np.sqrt(e[k])
            assert min(abs(part.whitened - want).max(), abs(part.whitened + want).max()) < 1e-8
            assert abs(part.explained - e[k] / np.trace(cov)).max() < 1e-9
            sums = [int(s) for s in fit.sum(0)]
            assert [int(d) for d in part.deviation] == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


def test_deviations_stay_exact():
    dice = random.Random(3)
    for n, top in ((5, 100), (10**9, 10**6), (10**12, 2**40), (7, 2**62)):
        x = [[dice.randrange(-top, top) for _ in range(5)] for _ in range(8)]
        sums = [dice.randrange(-n * min(top, 2**20), n * min(top, 2**20)) for _ in range(5)]
        assert WH.deviations(np.array(x, np.int64), n, sums) == [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


def test_whitening_of_little(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])]):
        assert WH.whiten(vec_frame(spark, rows)).count() == 0
    got = WH.whiten(vec_frame(spark, [(1, [0.5, 3e38]), (2, [0.25, -3e38]), (2, [0.25, -3e38]), (None, [0.75, 0])])).collect()
    assert len(got) in (4, 8) and {r.vec_id for r in got} == {1, 2, None}
    flat = WH.whiten(vec_frame(spark, [(k, [k / 8, 1.0, k / 4]) for k in range(9)])).collect()  # one direction only
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-9


# ---------------------------------------------------------------- collocations


def brute_phrases(rows, least, top):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for (lang, *p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        longer = [f for (other, *q), f in counts.items() if other == lang and len(q) > len(p) and f >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * f >= 80 * a for f in longer):
            continue
        cuts = [(2_000_000 * a // (counts[(lang, *p[:k])] + counts[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[(lang, *p[:k])], counts[(lang, *p[k:])], words[lang], score))
    final = []
    for lang in {o[0] for o in out}:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        final += [(lang, rank, *o[1:]) for rank, o in enumerate(best[:top], 1)]
    return sorted(final)


@pytest.mark.parametrize(("top", "bits"), [(3, 1 << 16), (25, 64), (2000, 1 << 16)])
def test_phrases_against_brute_force(spark, top, bits):
    dice = random.Random(top)
    zipf = [f"w{min(int(dice.paretovariate(0.7)), 40)}" for _ in range(500)]
    rows = []
    for _ in range(160):
        words = [dice.choice(zipf) for _ in range(dice.randrange(50))]
        for _ in range(dice.randrange(3)):
            at = dice.randrange(len(words) + 1)
            words[at:at] = dice.choice([["New", "york", "times", "square"], ["of", "course"], ["ein", "alter", "hut"], ["é", "É"]])
        text = "".join(w + dice.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";x "]) for w in words)
        rows.append((dice.choice(["en", "en", "de", None, "und"]), text))
    rows += [("en", None), ("fr", ""), ("en", "a " * 3000), ("de", rows[0][1]), ("de", rows[0][1])]
    docs = spark.createDataFrame([(k, t, lang, "clash", "c") for k, (lang, t) in enumerate(rows)], DOCS).withColumn("phrase", F.lit("clash"))
    got = sorted(tuple(r) for r in C.collocations(docs, least=4, top=top, filter_bits=bits).collect())
    assert got == brute_phrases(rows, 4, top)


def test_scores_are_exact_beyond_64_bits(spark):
    dice = random.Random(8)
    rows = [(a := dice.randrange(1, 2**62), a + dice.randrange(2**62), a + dice.randrange(2**61)) for _ in range(50)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(g.s == int(Fraction(2_000_000 * g.a, g.l + g.r)) for g in got)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, "", ""), (2, " . , ", "en", "", ""), (3, "lone words", "en", "", "")], DOCS)).count() == 0
