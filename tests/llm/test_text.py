"""Encoding, counting, language and chat formatting against libraries and brute force."""

import random
from collections import Counter as Tally

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from foldframe.llm import chat_preference as C
from foldframe.llm import merge_encoding as M
from foldframe.llm import rank_language as R
from foldframe.llm import viterbi_counts as V
from foldframe.llm.queries import model_file

HARD = ["", " ", "  a", "a  b ", "▁a ▁", "a\nb\t c\r\n", "😀𝒳 𝒳𝒳 é́", "<s> </s> <0x0A> <unk>", "\x00a", "ab" * 400 + " " * 70 + "x", "ﬁ Å　.", "the thing " * 50]


# ---------------------------------------------------------------- merge encoding


def test_encoding_is_the_librarys(spark, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    dice = random.Random(3)
    texts = HARD + ["".join(dice.choice("ab  .,é\n𝒳theing") for _ in range(dice.randint(0, 120))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, [1], "x") for k, t in enumerate(texts)] + [(None, None, [2], "y"), (0, texts[0], [1], "x")], "doc_id long, text string, ids array<int>, decoded string")
    got = M.encode_decode(docs, model_file()).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = lib.encode(texts[r.doc_id]) + [2] if r.doc_id is not None else [2]
        assert (r.ids, r.decoded) == (want, lib.decode(want))
    assert M.encode_decode(docs.limit(0), model_file()).count() == 0


def test_small_cache_and_long_agenda_change_nothing(monkeypatch):
    monkeypatch.setattr(M, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(M, "LIST_AGENDA", 0)
    code = M.MergeCoder(model_file())
    texts = [" ".join(f"word{k * j}" for j in range(30)) for k in range(70)]
    assert [g[0] for g in code.encode(texts)] == [code.lib.encode(t) + [2] for t in texts]
    assert code.decode(code.lib.encode("a  b")) == "a  b"


def test_a_difference_from_the_library_is_an_error(monkeypatch):
    code = M.MergeCoder(model_file())
    code.rank["▁the"] = M.NEVER
    with pytest.raises(ValueError, match="differ"):
        code.encode(["the this that"])


# ---------------------------------------------------------------- unigram counts


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_are_the_librarys(spark):
    pieces = V.model_pieces(model_file())
    lib = library(pieces)
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(HARD)] + [(None, None, 7)], "doc_id long, text string, n_tokens int")
    for r in V.count_tokens(docs, pieces).collect():
        assert r.n_tokens == (0 if r.doc_id is None else len(lib.encode(HARD[r.doc_id], add_special_tokens=False).ids))


def test_counts_with_ties_unknowns_and_bytes():
    dice = random.Random(1)
    for k in range(20):
        pieces = [("<unk>", 0.0)] + [(p, float(-dice.randint(1, 3))) for p in sorted({"".join(dice.choice("abé▁") for _ in range(dice.randint(1, 3))) for _ in range(12)})]
        if k % 2:
            pieces += [(f"<0x{b:02X}>", -2.0) for b in range(256)]
        lib, mine = library(pieces), V.Counter(pieces)
        for _ in range(100):
            s = "".join(dice.choice("abé c") for _ in range(dice.randint(0, 12)))
            assert mine.text(s)[0] == len(lib.encode(s, add_special_tokens=False).ids), (s, pieces)


# ---------------------------------------------------------------- language


def brute_grams(text):
    out, word = [], []
    words = []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(c)
        elif word:
            words.append("".join(word))
            word = []
    for w in words:
        p = f"_{w}_"
        out += [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]
    return out


def unpack(g):
    cs = []
    while True:
        cs.append(g & 0x1FFFFF)
        g >>= 21
        if not g:
            return "".join("_" if c == R.EDGE else chr(c) for c in reversed(cs))


@pytest.mark.parametrize("text", ["Ab, c", "x", "Élan über! 42 naïve", "  a", "日本 語"])
def test_grams(text):
    got = Tally(unpack(int(g)) for g in R.grams([text]))
    want = Tally(brute_grams(text))
    # Words share the border between them, so "a b" has "a_" and "_b"; three-grams across it are left out on both sides.
    assert got == want


def test_profiles_and_prediction(spark):
    train = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "fr"), ("zzz", None)] * 3
    docs = spark.createDataFrame(train, "text string, lang string")
    size = 25
    profiles = R.learn_profiles(docs, size=size)
    for lang in ("en", "de", "fr"):
        tally = Tally(g for t, k in train if k == lang for g in brute_grams(t))
        have = {unpack(r.gram): r.rank for r in profiles.where(F.col("lang") == lang).collect()}
        assert len(have) == min(size, len(tally))
        assert [tally[g] for g in sorted(have, key=have.get)] == sorted(tally.values(), reverse=True)[:size]
    ask = spark.createDataFrame([(1, "the dog", "x"), (2, "und der hund", "x"), (3, None, "x"), (4, "12 34 !?", "x"), (5, "", "x"), (None, "le chien", "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in R.predict_language(ask, profiles, size=size).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "fr"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert {r.lang_pred for r in R.predict_language(ask, profiles.limit(0)).collect()} == {"und"}
    assert R.learn_profiles(docs.limit(0)).count() == 0


def test_merging_counts_early_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(f"word{k} und mehr {k * k}", "de") for k in range(300)], "text string, lang string")
    want = sorted(map(tuple, R.learn_profiles(docs).collect()))
    monkeypatch.setattr(R, "MERGE_AT", 10)
    assert sorted(map(tuple, R.learn_profiles(docs).collect())) == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = R.predict_language(docs, R.learned_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(R.held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# ---------------------------------------------------------------- chats


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda ts: [f"<|im_start|>{r}\n{t.replace('<|im_', '<| im_')}<|im_end|>\n" for r, t in ts]

    def spans(ts):
        out, at = [], 0
        for (r, t), piece in zip(ts, show(ts), strict=True):
            if r == "assistant":
                start = at + piece.index("\n") + 1
                out.append((start, len(piece) - (start - at) - 1))
            at += len(piece)
        return out

    return n, "".join(show(chosen[:n])), "".join(show(chosen[n:])), "".join(show(rejected[n:])), spans(chosen[n:]), spans(rejected[n:])


def test_pairs_hold_against_brute_force(spark):
    dice = random.Random(4)
    talk = lambda n: [(dice.choice(["user", "assistant", "system"]), dice.choice(["a", "b<|im_end|>", "", "é\n😀"])) for _ in range(n)]
    rows = []
    for k in range(40):
        head = talk(dice.randint(0, 3))
        rows.append((k, head + talk(dice.randint(0, 3)), head + talk(dice.randint(0, 3)), "mine"))
    pairs = spark.createDataFrame(rows + [(99, None, [(None, None)], "mine")], "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, note string")
    got = {r.conv_id: r for r in C.preference_pairs(pairs).collect()}
    for k, a, b, _ in rows:
        r = got[k]
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans]) == brute_pair(a, b)
        assert r.note == "mine"
        for text, marked in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[s.start : s.start + s.length].endswith("<|im_end|>") for s in marked)
    assert (got[99].prompt_turns, got[99].chosen, got[99].rejected) == (0, "", "<|im_start|>\n<|im_end|>\n")


def test_conversations_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, None, None), (2, None, "user", "x"), (2, 1, "assistant", "y")]
    convs = C.conversations(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string"))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in convs.collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], None: [("", "")], 2: [("user", "x"), ("assistant", "y")]}
    assert C.preference_pairs(C.derived_rejections(convs)).count() == 3
    assert C.preference_pairs(C.derived_rejections(convs.limit(0))).count() == 0
    plan = C.preference_pairs(C.derived_rejections(convs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_preferences_with_columns_of_the_results_names(spark):
    turns = [("user", "q"), ("assistant", "a")]
    pairs = spark.createDataFrame([(1, "old", "x", "y", turns, turns[:1])], "conv_id long, prompt string, Prompt_Turns string, __c string, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = C.preference_pairs(pairs)
    assert got.columns == ["conv_id", "prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"]
    row = got.first()
    assert row.prompt_turns == 1 and row.rejected == "" and row.prompt != "old"


def test_chunks_cut_letters_from_marks_only_where_pieces_allow_it():
    cut = M.borders(["ab", "▁a", ".\n", "▁(", "²."]).findall
    assert cut("▁ab.\n▁▁(ab²._1é▁") == ["▁ab", ".\n", "▁▁(", "ab", "²._1", "é", "▁"]
    assert M.borders(["a."]).findall("▁ab.\n▁c") == ["▁ab.\n", "▁c"]


def test_the_cache_keeps_frequent_chunks(monkeypatch):
    monkeypatch.setattr(M, "CACHE_ENTRIES", 4)
    code = M.MergeCoder(model_file())
    texts = [f"the w{k} {chr(0x4E00 + k)}x, the end" for k in range(200)]
    assert [g for t in texts for g in code.encode([t])] == [(code.lib.encode(t) + [code.end], t) for t in texts]
    assert len(code.old) <= 16 and len(code.young) <= 16


def test_profiles_are_cut_before_the_shuffle(spark):
    plan = R.learn_profiles(spark.createDataFrame([("ab", "x")], "text string, lang string"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
