"""Archives, main text and site quality."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.llm import html_graph as H
from foldframe.llm import legacy_archive as A
from foldframe.llm import site_quality as S
from foldframe.llm.work import Work

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- archives


def test_both_versions_and_declared_lengths():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\n\r\nfiledesc://x 1\nhttp://not.a.header 5\n"
        data = A.arc_head("n", version, "20010203040506") + b"\n" + A.arc_record(version, "http://a/", "20010203040506", "text/html", body, "n", 9) + b"\n\n" + A.arc_record(version, "dns:b", "2001", "text/dns", b"", "n", 9) + b"\n"
        got = [*A.parse_arc(data)]
        assert [(r["version"], r["url"], r["mime"], r["content"]) for r in got] == [(version, "http://a/", "text/html", body), (version, "dns:b", "text/dns", b"")]
    for broken in (data[:-20], b"http://a/ 0.0.0.0 2001 text/html 3\nabc", A.arc_head("n", 1, "2001") + b"\nhttp://a/ 0.0.0.0 2001 3\nabc", A.arc_head("n", 1, "2001") + b"\nhttp://a/ 0.0.0.0 2001 text/html x\nabc"):
        with pytest.raises(ValueError):
            [*A.parse_arc(broken)]
    assert A.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and A.warc_date("2001") == "2001-01-01T00:00:00Z"


def test_round_trip_of_hard_pages(spark, monkeypatch):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 300)
    rows = [(1, "http://a/ b\n", "same"), (5, None, "same"), (3, "u", "same"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.0\r\n\r\nfiledesc://\n\n 12\n"), (8, "é", "ä" * 100_000), (None, "u", "same"), (None, "u", "lone"), (9, "u", "twice"), (9, "u", "twice")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in A.archived_pages(pages).collect())
    want = []
    for k, (i, _, html) in enumerate(rows):
        p = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = (i == max(same) and k != 10) if same else True
        want.append((str(i), len(p), b32(p), "response" if first else "revisit", "None" if first else str(max(same))))
    assert got == sorted(want)
    short = A.archived_pages(pages, min_bytes=5)
    assert short.where("payload_bytes < 5 and record_type = 'revisit'").count() == 0
    assert A.archived_pages(pages.limit(0)).count() == 0


def test_warc_fields_and_resources(spark):
    work = Work(spark, "test-archives")
    data = A.arc_head("n", 1, "2001") + b"\n" + A.arc_record(1, "dns:b", "20010203040506", "text/dns", b"1.2.3.4", "n", 9) + b"\n" + A.arc_record(1, "http://b/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 3\r\n\r\nhi", "n", 9)
    A.write_archives(spark.createDataFrame([("legacy", 0, bytearray(data))], A.ARCHIVED), work.path("arc"), "arc")
    A.convert(spark, work.path("arc"), work.path("warc"), work)
    got = {r.record_type: r for r in A.read_warc(spark, work.path("warc")).collect()}
    assert set(got) == {"resource", "response"}
    assert got["resource"].payload_digest == b32(b"1.2.3.4") and got["resource"].url == "dns:b" and got["resource"].date == "2001-02-03T04:05:06Z"
    assert got["response"].rank == 3 and got["response"].payload_bytes == 2 and got["response"].record_id.startswith("urn:uuid:")
    raw = gzip.decompress(A.archive_bytes(spark, work.path("warc")).first().content)
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n") and raw.endswith(b"\r\n\r\n")


# ---------------------------------------------------------------- main text


@pytest.fixture(scope="module")
def model(spark):
    return H.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


ARTICLE = "<h1>A title &amp; more</h1><p>First   paragraph,\n with <b>bold</b> and <a href=x>link</a> words that go on for a while.<p>Second &lt;paragraph&gt; that has quite a few words in it too, as texts have.</p><p>Short.</p>"
TEXT = "A title & more\nFirst paragraph, with bold and link words that go on for a while.\nSecond <paragraph> that has quite a few words in it too, as texts have.\nShort."


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><article>{}</article><footer>&copy; 2020 Some company. All rights.</footer></body></html>",
    "<body><header><div class=logo>Site</div></header><div class='cookie-notice'><p>We use cookies to make this site better for you and for us.</p><button>OK</button></div><main>{}</main><aside class=sidebar><h3>Related</h3><ul><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li></ul></aside><footer>Legal</footer>",
    "<div id=menu><a href=1>One</a> | <a href=2>Two</a></div><div class='ad'>Buy these fine shoes now, they are cheap and good and red.</div><article>{}</article><section class=comments><h3>2 comments</h3><div class=comment><p>I think that this is quite wrong, and I will say so here.</p></div><div class=comment><p>Me too.</p></div></section><form><label>Name</label><input><p>Send us a message</p></form>",
    "<script>var a='<p>no</p>';</script><article>{}</article><script>x</script><!-- <p>hidden comment</p> -->",
])
def test_article_without_the_rest(model, page):
    assert model.main_text(page.replace("{}", ARTICLE)) == TEXT


PARAGRAPHS = [f"Paragraph {i} of the story says that the river rose in the night, and nobody slept well." for i in range(3)]


@pytest.mark.parametrize("page, title", [
    ("<body>{}</body>", ""),
    ("<body><h1>The title</h1>{}</body>", "The title"),
    ("<html><head><title>x</title>{}", ""),
    ("<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><header><h1>The title</h1></header>{}</article><footer>&copy; 2020 Us</footer>", "The title"),
    ("<body><article><div class=post-header><h1>The title</h1></div>{}</article>", "The title"),
    ("<body><div class=post><div class=entry-header><h1>The title</h1></div>{}</div><div class=comments><p>I liked it very much, thanks.</p></div>", "The title"),
])
def test_articles_of_other_forms_stay(model, page, title):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    assert model.main_text(page.replace("{}", text)) == "\n".join([title, *PARAGRAPHS] if title else PARAGRAPHS)


def test_formulas_stay(model):
    assert model.main_text("<body><article><h1>T</h1><p>a <math>x+1</math> b</p></article>") == "T\na x+1 b"


def test_marginals_are_those_of_enumeration(model):
    tree = H.parse("<div><p>one two three four five six</p><ul class=menu><li><a>x</a></li></ul></div><p>more words here.</p>")
    odds, kinds, n = H.features(tree) @ model.weights, H.edge_kinds(tree), len(tree.tag)
    total, one = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        w = np.exp(sum(odds[i] * y[i] for i in range(n)) + sum(model.tables[kinds[i], y[tree.parent[i]], y[i]] for i in range(1, n)))
        total += w
        one += w * np.array(y)
    assert np.allclose(model.marginals(tree), one / total)


def test_pages_of_odd_html(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all, only some text"), (4, "u", "<p><div></p></li><table><td>"), (None, "u", "<p>" * 3000 + "deep"), (6, "u", "<article><p>" + "long words. " * 50_000 + "</p></article>"), (6, "u", "<b")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(pages, model).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert next(r for r in got if r.page_id == 1).text == ""
    assert max(len(r.text) for r in got) == 50_000 * 12 - 1
    assert H.extract(pages.limit(0), H.train(pages.limit(0))).count() == 0


# ---------------------------------------------------------------- site quality


def test_features_and_posteriors(spark):
    good, bad = "Some plain words make a sentence, and it ends here. " * 4, "## $$ BUY!! BUY!! BUY!! %% && "
    docs, labels = [], []
    for k in range(240):
        site = "poor" if k % 3 == 0 else "fine"
        docs.append((k, (bad if site == "poor" and k % 12 else good) + str(k), site, "en", 1.0))
        labels.append((k, 0 if site == "poor" and k % 12 else 1))
    docs += [(900, good, "new", None, 1.0), (901, None, None, None, 1.0), (None, "", "poor", "en", 1.0), (0, good + "0", "poor", "en", 1.0)]
    got = S.site_quality(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality double"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int"))
    assert got.count() == len(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert all(0 <= r.quality <= 1 for r in rows.values())
    assert rows[1].keep and not rows[3].keep
    assert rows[1].host_mean > rows[900].host_mean > rows[3].host_mean  # the site of one document lies between
    assert rows[900].path_docs == 1 and abs(rows[900].path_mean - rows[900].host_mean) < 1e-9  # a document never speaks for itself


def test_posterior_means_by_hand(spark, monkeypatch):
    monkeypatch.setattr(S, "strength", lambda *_: 2.0)
    scored = spark.createDataFrame([(1, "h", "a", 0.0, 0.8), (2, "h", "a", 1.0, 0.6), (3, "h", "b", 0.0, 0.2), (4, None, None, 0.0, 0.4)], "id long, host string, path string, evidence double, p double")
    got = {r.id: r for r in S.site_posteriors(scored).collect()}
    mean = 2.0 / 4
    host = (1.6 + 2 * mean) / 5
    assert got[1].host_mean == pytest.approx(host) and got[4].host_mean == pytest.approx((0.4 + 2 * mean) / 3)
    path = (0.6 + 2 * host) / 3
    assert got[1].path_mean == pytest.approx(path)
    assert got[2].quality == pytest.approx(1 / (1 + np.exp(-(np.log((0.8 + 2 * host) / 3 / (1 - (0.8 + 2 * host) / 3)) + 1))))


def test_strength_by_spread(spark):
    row = lambda n, s, q: (n, float(s), q)
    alike = spark.createDataFrame([row(100, 50, 0.5)] * 20, "n long, s double, q double")
    apart = spark.createDataFrame([row(100, 5, 0.5), row(100, 95, 0.5)] * 10, "n long, s double, q double")
    assert S.strength(apart, "s", "q") < 2 < S.strength(alike, "s", "q")
    assert S.strength(apart, "s", "q", (3.0, 4.0)) == 3 and S.strength(alike, "s", "q", (1.0, 1.5)) == 1.5


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", "h", "en"), (2, "b", "h", "en")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality for r in S.site_quality(docs, none).collect()} == {0.5}
    assert S.site_quality(docs.limit(0), none).count() == 0


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    teach = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    seen = S.site_quality(docs, teach).withColumnRenamed("quality", "q").join(labels.join(teach, "doc_id", "left_anti"), "doc_id")
    assert seen.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.95
