"""One named query per text operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.chat_preference import conversations, derived_rejections, preference_pairs
from foldframe.llm.collocations import collocations
from foldframe.llm.exact_dedup import exact_groups
from foldframe.llm.html_graph import extract, train
from foldframe.llm.jaccard_join import shingle_components
from foldframe.llm.legacy_archive import archived_pages
from foldframe.llm.merge_encoding import encode_decode
from foldframe.llm.rank_language import held_out, learned_profiles, predict_language
from foldframe.llm.repair_shards import sharded_ids
from foldframe.llm.site_quality import site_quality
from foldframe.llm.suffix_decontam import benchmark_matches, contamination
from foldframe.llm.viterbi_counts import count_tokens, model_pieces
from foldframe.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL for lower-casing A-Z only.
ASCII = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """A public tokenizer file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


OP1_SQL = f"""with recursive w as (select doc_id, regexp_extract_all({ASCII.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g,
    len(w) >= 4 as full from w),
  n as (select doc_id, count(*) as n from s group by doc_id),
  i as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.full = b.full and a.doc_id < b.doc_id group by 1, 2),
  l as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
  e as (select x, y from l union select y, x from l),
  r(doc_id, y) as (select x, y from e union select r.doc_id, e.y from r join e on e.x = r.y),
  m as (select doc_id, min(y) as y from r group by doc_id)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id"""


@query("op1_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


OP2_SQL = """with p as (select page_id, coalesce(html, '') as h from pages), s as (select *, max(page_id) over (partition by h) as k, sha1(h) as x from p),
  g as (select *, list_transform(range(0, 8), lambda i: cast('0x' || x[5 * i + 1:5 * i + 5] as bigint)) as v from s)
  select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
    array_to_string(list_transform(v, lambda b: array_to_string(list_transform([15, 10, 5, 0], lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((b >> j) & 31) + 1]), '')), '') as payload_digest,
    case when page_id = k then 'response' else 'revisit' end as record_type, case when page_id = k then null else k end as refers_to from g"""


@query("op2_legacy_archive", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


OP3_SQL = """with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
  b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
  bw as (select item_id, least(13, len(w)) as n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) as win from b where len(w) > 0),
  sizes as (select distinct n from bw),
  dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n) x),
  m as (select distinct dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
  h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) x group by doc_id),
  t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from m group by doc_id)
  select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.items, '')) as items_sha256,
    coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""


@query("op3_suffix_decontam", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


#: The twin knows that these pages keep their article in one element of that name, with headings and paragraphs as blocks.
OP4_SQL = r"""with b as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>') as parts from pages),
  t as (select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') as parts from b)
  select page_id, url, array_to_string(parts, chr(10)) as text, cast(length(array_to_string(parts, chr(10))) as bigint) as n_chars from t"""


@query("op4_html_graph", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_site_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_viterbi_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_pieces(model_file()))


@query("op7_rank_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, learned_profiles(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_merge_encoding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), model_file())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_exact_dedup", f"""with d as (select doc_id, {ASCII.format('text')} as t from documents)
  select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256 from d window w as (partition by t)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


_TURN = "'<|im_start|>' || replace({0}.role, '<|im_', '<| im_') || chr(10) || replace({0}.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10)"
_SPANS = """array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: case when {0}[i].role = 'assistant' then
  cast(coalesce(list_sum(list_transform({0}[1:i - 1], lambda t: length({1}))), 0) + 13 + length({0}[i].role) as bigint) || ':' || (length({2}) - 14 - length({0}[i].role)) end), lambda s: s is not null), ',')"""


def _spans(name: str) -> str:
    return _SPANS.format(name, _TURN.format("t"), _TURN.format(f"{name}[i]"))


OP10_SQL = f"""with c as (select conv_id, list_sort(list(struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, '')))) as t from conversations group by conv_id),
  a as (select conv_id, list_transform(t, lambda x: struct_pack(role := x.role, text := x.text)) as t, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') as a from c),
  d as (select *, case when len(a) > 0 then a[conv_id % len(a) + 1] end as d, case when len(a) > 1 then t[a[(conv_id % len(a) + 1) % len(a) + 1]].text else '' end as says from a),
  r as (select conv_id, t as c, case when len(a) > 0 then list_transform(range(1, len(t) + 1), lambda i: struct_pack(role := t[i].role, text := case when i = d then says else t[i].text end)) else t[1:len(t) - 1] end as r from d),
  p as (select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) as n from r),
  q as (select conv_id, cast(n as integer) as n, c[1:n] as p, c[n + 1:] as c, r[n + 1:] as r from p)
  select conv_id, n as prompt_turns, array_to_string(list_transform(p, lambda t: {_TURN.format('t')}), '') as prompt, array_to_string(list_transform(c, lambda t: {_TURN.format('t')}), '') as chosen,
    array_to_string(list_transform(r, lambda t: {_TURN.format('t')}), '') as rejected, {_spans('c')} as chosen_spans, {_spans('r')} as rejected_spans from q"""


@query("op10_chat_preference", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference_pairs(derived_rejections(conversations(table(spark, sf_dir, "conversations"))))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",").alias(c)
    return made.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


@query("op11_repair_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_ids(table(spark, sf_dir, "documents"), model_file("byte_bpe_50k.json"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


OP13_SQL = f"""with recursive p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({ASCII.format('text')}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
  w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
  n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
  g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) as s(k) where len(w) >= k),
  f as (select lang, k, phrase, count(*) as f from g group by lang, k, phrase having count(*) >= 30),
  c as (select lang, k, phrase, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from f where k > 1),
  s as (select c.lang, c.phrase, c.k, c.a, c.cut, l.f as l, r.f as r, cast((2000000 * c.a::hugeint) // (l.f + r.f) as bigint) as score from c
    join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(w[cut + 1:], ' ')),
  b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
  o as (select f.lang, array_to_string(string_split(f.phrase, ' ')[i:i + j - 1], ' ') as phrase, max(f.f) as f from f, range(1, 5) as x(i), range(2, 4) as y(j) where j < f.k and i + j - 1 <= f.k group by 1, 2),
  k as (select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, score from b left join o on o.lang = b.lang and o.phrase = b.phrase where o.f is null or 100 * o.f < 80 * a)
  select k.lang, rank, phrase, a, l, r, n.n, score from k join n on n.lang = k.lang where rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
