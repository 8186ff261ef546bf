import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import corpus, search
from lexmill.sources import dom, feeds, pages

DOCUMENT = """<html><body><nav class="ant-breadcrumb"><ol><li class="ant-breadcrumb-item"><a href="/van-ban/trung-uong">TW</a></li><li class="ant-breadcrumb-item"> Luật số 1 </li></ol></nav>
<div class="ant-tabs-tabpane ant-tabs-tabpane-active"><p>Điều 1.&nbsp;A</p><p>1. B<br>C</p><script>x</script></div>
<div class="ant-descriptions-item-container"><span class="ant-descriptions-item-label">Số hiệu</span><span class="ant-descriptions-item-content"> 1/2020 </span></div>
<div class="ant-card"><span class="font-bold">Văn bản bãi bỏ (1)</span><ul><li><a>Luật số 2</a><li><a> </a></ul></div></body></html>"""
LISTING = """<form><input type=hidden name=__VIEWSTATE value="v"><select id="a_drdDocCategory" name="n1"></select><select id="a_drdDocOrg" name="n2"></select><select id="a_drdDocYear" name="n3"></select><select id="a_drdRecordPerPage" name="n4"></select><input id="a_txtSearchKeyword" name="n5"><input id="a_btnSearch" name="n6">
<table id="ctl_grvDocument"><tr><th>h</th></tr><tr><td><a href="/d?id=1"><span class="code">12/2020/NĐ-CP</span></a></td><td><span class="issued-date">3/4/2020</span></td><td><span class="substract">Tiêu đề</span><div class="bl-doc-file"><a href="https://f/x.pdf">f</a></div></td></tr><tr><td>x</td></tr></table>
<span id="document_page_info">1 - 50 | 120</span></form>"""
DETAIL = """<div class="Content"><table><tr><td class="col1">Số ký hiệu</td><td>12/2020</td></tr><tr><td class="col1">Ngày ban hành</td><td>03-04-2020</td></tr></table><a class="view-file" href="u">v</a></div>"""


def parsed(spark, f, html):
    return f(spark.createDataFrame([("https://h.org/p", html)], "url string, html string"), "url", "html")


def test_document_pages(spark):
    r = parsed(spark, pages.parse_document_pages, DOCUMENT).first()
    assert (r["scope"], r["title"], r["fullText"]) == ("trung-uong", "Luật số 1", "Điều 1. A\n1. B\nC")
    assert [tuple(a) for a in r["attributes"]] == [("Số hiệu", "1/2020")]
    assert [(c["categoryLabel"], c["entries"]) for c in r["relations"]] == [("Văn bản bãi bỏ (1)", ["Luật số 2"])]
    assert parsed(spark, pages.parse_document_pages, None).first()["scope"] == "unknown"


def test_listing_and_detail_pages(spark):
    r = parsed(spark, pages.parse_listing_pages, LISTING).first()
    assert r["hiddenFields"] == {"__VIEWSTATE": "v"} and r["controls"]["gridView"] == "ctl$grvDocument" and (r["shownCount"], r["totalCount"]) == (50, 120)
    assert [tuple(x) for x in r["rows"]] == [("12/2020/NĐ-CP", "Tiêu đề", "03/04/2020", "https://h.org/d?id=1", ["https://f/x.pdf"])]
    assert parsed(spark, pages.parse_listing_pages, "").first()["controls"] is None
    d = parsed(spark, pages.parse_detail_pages, DETAIL).first()
    assert (d["citation"], d["date"], d["docType"], d["fileUrls"]) == ("12/2020", "03/04/2020", None, ["u"])
    assert parsed(spark, pages.parse_detail_pages, "<p>x</p>").count() == 0
    assert list(pages.pages_needed(120, 50)) == [2, 3, 4] and len(pages.pages_needed(10**6, 10)) == 49


def test_allow_list(spark):
    urls = ["https://a.example.org/x", "http://a.example.org/x", "https://example.org.evil/x", "https://example.org/no/x", "bad url", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(pages.allowed(F.col("u"), suffixes=["example.org"], forbidden=["/no"])).collect()] == [True, False, False, False, False, False]


def test_sitemap_and_search_response(spark):
    xml = "<x><!--S--><loc>u0</loc><!--A--><loc> u1 </loc><loc>u2</loc><!--B--><loc>u3</loc></x>"
    df = spark.createDataFrame([(xml,)], "x string")
    assert df.select(feeds.sitemap_locations(F.col("x"), "<!--A-->", "<!--B-->")).first()[0] == ["u1", "u2"]
    assert df.select(feeds.sitemap_locations(F.col("x"), "<!--A-->", "<!--Z-->")).first()[0] == ["u1", "u2", "u3"]
    with pytest.raises(Exception, match="no marker"):
        df.select(feeds.sitemap_locations(F.col("x"), "<!--Q-->", "<!--B-->")).collect()
    body = "0:[1]\n1:{bad\n2:" + json.dumps({"total": 1, "pageNumber": 1, "pageSize": 10, "items": [{"id": "7", "title": "t", "docNum": "1/2", "docType": None, "issueDate": "2024-01-18T00:00:00", "effFrom": None, "effTo": None, "effStatus": {"name": "s"}, "agencyName": "a"}]})
    r = feeds.search_results(spark.createDataFrame([(body,)], "b string"), "b", "https://h/").first()
    assert (r["total"], r["source_url"], r["document_type"], r["issued_date"], r["effective_date"], r["validity_status"]) == (1, "https://h/7", "", "2024-01-18", None, "s")
    with pytest.raises(Exception, match="no JSON object"):
        feeds.search_results(spark.createDataFrame([("0:x",)], "b string"), "b", "").collect()


ENTRIES = [("36/2024/QH15", "Luật Trật tự, an toàn giao thông đường bộ", "27/06/2024", 0), ("36/2024/QH15", "Phụ lục", "27/06/2024", 1), ("45/2019/QH14", "Bộ luật Lao động", "20/11/2019", 2), ("1/2020", "Bộ luật Lao động cũ", None, 3)]


def test_corpus_lookup(spark):
    e = spark.createDataFrame([(*x[:3], "s", f"f{x[3]}", "n.pdf", [f"u{x[3]}"], x[3]) for x in ENTRIES], "citation string, title string, date string, subdir string, folder string, filename string, fileUrls array<string>, position int")
    find = lambda **q: [r["position"] for r in corpus.best_match(e, **q).collect()]
    assert find(citation=" 36/2024/qh15 ") == [0]
    assert find(title="bo luat lao dong") == [2] and find(title="an toan giao thong") == [0] and find(title="xyz qqq") == []
    assert find(title="Bộ luật Lao động", date_to="2019-11-19") == [] and find(title="Bộ luật Lao động", date_from="2019-11-20", date_to="2019-11-20") == [2]
    assert find() == []
    files = spark.createDataFrame([("s/f0/n.pdf",)], "path string")
    assert sorted((r["position"], r["exists"]) for r in corpus.document_status(e, files, citation="36/2024/QH15").collect()) == [(0, True), (1, False)]
    assert {r["citation"]: r["urls"] for r in corpus.attachment_urls(e).collect()}["36/2024/QH15"] == ["u0", "u1"]


def test_rollup_and_files(spark, tmp_path):
    root = f"file://{tmp_path}/laws"
    assert len(feeds.scaffold(spark, root)) == 16 and feeds.scaffold(spark, root) == []
    (tmp_path / "laws/08-thong-tu-bo-nganh/x").mkdir()
    (tmp_path / "laws/08-thong-tu-bo-nganh/x/a.pdf").write_bytes(b"12345")
    (tmp_path / "laws/08-thong-tu-bo-nganh/x/b.pdf.part").write_bytes(b"1")
    files = feeds.file_listing(spark, root)
    got = {r["folder"]: (r["files"], r["bytes"]) for r in corpus.rollup(files).collect()}
    assert got == {"": (1, 5), "08-thong-tu-bo-nganh": (1, 5), "08-thong-tu-bo-nganh/x": (1, 5)}
    tiers = corpus.tier_overview(files).collect()
    assert len(tiers) == 14 and [(r["tier"], r["files"]) for r in tiers if r["files"]] == [(8, 1)] and corpus.tier_overview(files, 2).count() == 1
    assert feeds.read_manifest(spark, f"{root}/manifest.json").count() == 0
    log = spark.createDataFrame([('a "q", b', "s", "f", 200, 5)], "citation string, subdir string, filename string, http_code int, bytes long")
    for _ in range(2):
        feeds.write_log(log, f"file://{tmp_path}/log")
    assert [tuple(r) for r in feeds.read_log(spark, f"file://{tmp_path}/log").collect()] == [tuple(log.first())] * 2


def test_filters():
    with pytest.raises(ValueError):
        search.Filters(scope="x")
    with pytest.raises(ValueError):
        search.Filters(page=0)
    assert search.parse_day("31/02/2024") is None and search.flag("false") is False and search.flag("1") is True
    assert search.Filters().empty() and not search.Filters(keyword="x").empty()


def _dump(e):
    return [e.tag, e.attrs, [x if isinstance(x, str) else _dump(x) for x in e.children], [x.tag for x in e.below()]]


def _merged(tree):
    out = []
    for x in tree[2]:
        if isinstance(x, str) and out and isinstance(out[-1], str):
            out[-1] += x
        else:
            out.append(x if isinstance(x, str) else _merged(x))
    return [tree[0], tree[1], out, tree[3]]


def test_plain_markup_gives_the_tokenizers_tree(monkeypatch):
    """Pages of random pieces, plain and odd ones; every tag of a listing went through the tokenizer."""
    rng = random.Random(5)
    plain = ["<table>", "<tr>", "<td>", '<td class="a b">', "<TD Class=x>", "</td>", "</tr>", "</TABLE>", "<p>", "</p>", "<br>", "<input type=hidden name=v>", '<a href="/d?id=1">', "</a>", "x &amp; y &lt", "Điều\n1 ", "&", '<i a="" b>', '<i a="1"  a="2">', "</b>", "<li>", "</ul>", '<a href="">']
    odd = ["<br/>", "<a b='1'>", "<!-- <p> -->", "<script>a<b</script>", "< p", '<a b="x&amp;y">', "</td >", "<a b = 2>", '<a b="c"d>', "<!DOCTYPE html>", "<title>a<b></title>", "<", "<é>", '<a b="1>2">', "<a\tb=1>", "<?x?>"]
    pages_ = ["".join(rng.choices(plain + odd * (i % 2), k=rng.randrange(25))) for i in range(3000)]
    fast = [_merged(_dump(dom.parse(x))) for x in pages_]
    with monkeypatch.context() as m:
        m.setattr(dom._Builder, "plain", lambda self, html: False)
        assert fast == [_merged(_dump(dom.parse(x))) for x in pages_]
    monkeypatch.setattr(dom._Builder, "feed", lambda self, html: pytest.fail("went through the tokenizer"))
    for x in pages_[::2]:
        dom.parse(x)
