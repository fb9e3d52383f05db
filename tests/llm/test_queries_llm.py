"""All registered text queries: SQL twins, result columns, and the pipeline against brute force over planted rows."""

import random

import corpus_pipeline
import pytest
import sentencepiece
from oracle_check import compare, connect
from test_matching import brute_components, brute_matches, low

from foldframe.llm.queries import ORACLES, QUERIES, model_file

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_shingles component_id", 2: "page_id payload_bytes payload_digest record_type refers_to", 3: "doc_id n_words n_hit n_items items_sha256 contaminated", 4: "page_id url text n_chars",
    5: "doc_id quality keep", 6: "doc_id n_tokens", 7: "doc_id held_out lang_pred score", 8: "doc_id n_tokens ids_sha256 decoded_sha256", 9: "doc_id keep_id group_size kept text_sha256", 10: "conv_id prompt chosen rejected",
    11: "doc_id start n_tokens ids_crc32", 12: "vec_id component n deviation whitened explained identity_error", 13: "lang rank phrase a l r n score",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]).startswith("ok")


def test_every_operator_has_one_query_with_its_columns(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == sorted(COLUMNS)
    for name in ("op5_site_quality", "op6_viterbi_counts", "op7_rank_language", "op8_merge_encoding"):
        df = QUERIES[name](spark, SF)
        assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(df.columns)
        assert df.count() == 200 == df.select("doc_id").distinct().count()
    shards, white = QUERIES["op11_repair_shards"](spark, SF), QUERIES["op12_whitening"](spark, SF)
    assert dict(shards.dtypes) == {c: "bigint" for c in COLUMNS[11].split()} and shards.count() == 200
    assert white.columns == COLUMNS[12].split() and dict(white.dtypes)["deviation"] == "bigint" and white.count() == 8 * 500


def test_pipeline_holds_against_brute_force(spark, tmp_path):
    dice = random.Random(9)
    text = lambda n: " ".join(dice.choice("the of and wort über maison casa".split()) + str(dice.randrange(60)) for _ in range(n))
    items = [(k, text(dice.choice([5, 20, 40]))) for k in range(6)]
    docs = []
    for _ in range(40):
        base = text(dice.choice([3, 30, 120]))
        docs.append(base)
        if dice.random() < 0.4:
            docs += [base.upper(), base + " tail", base.replace("the", "die", 1)]
        if dice.random() < 0.3:
            docs.append(text(20) + " " + dice.choice(items)[1] + " " + text(10))
    docs += ["", None, "12 34 --", docs[0]]
    rows = [(k, t, None if k % 7 == 0 else "en", "src0", len(t or "")) for k, t in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows.append((None, "a text without an id", "en", None, None))
    rows.append(rows[0])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    left = {(i, t) for i, t in left if i is None or i == max(k for k, u in left if k is not None and low(u) == low(t))}
    comps = {i: c for i, _, c in brute_components([(i, t) for i, t in left if i is not None], 5, 80, 100)}
    left = {(i, t) for i, t in left if i is None or comps[i] == i}
    hits = brute_matches([*left], [(str(k), t) for k, t in items])
    left = {(i, t) for i, t in left if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    assert set(got) == {i for i, _ in left}
    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    assert all(got[i].ids == lib.encode(t) + [2] and got[i].round_trip for i, t in left)
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "exact dedup" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
