"""HTML extraction and WARC fixity."""

import hashlib
import re
import time
from html import unescape

import pytest

from cairn.llm import html_extract as hx
from cairn.llm import queries
from cairn.llm import warc_fixity as wf

DATA = "/root/testdata/sf0.01"


def test_given_pages(spark):
    """The article's blocks, by a pattern that knows how these pages are made."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = {r.page_id: r for r in hx.extract_main_text(pages).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>|<br>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert out[r.page_id].text.split("\n") == [b for b in blocks if b]


CASES = {
    "": "",
    "just text": "just text",
    "<p>a &amp; b &eacute; &#65;<p>c\n\n d</p>": "a & b é A\nc d",
    "<body><nav><p>menu, menu, menu</nav><div class='content'><p>Body text, long enough to count, surely.</p></div><div id=sidebar><p>side, side, side</div>": "Body text, long enough to count, surely.",
    "<article><h1>T</h1><p>One<br>two</p><script>var a = '<p>no</p>'</script><form><p>x</form><ul><li>i<li>j</ul></article><section class='comments'><p>c, c, c</section>": "T\nOne two\ni\nj",
    "<div><p>" + "good words, many, " * 20 + "</p><p>short</p><p><a href=x>" + "link text, " * 30 + "</a></p></div>": None,
    "<p>cut <b": "cut",
    "<!-- <p>no</p> --><p>yes</p><!-- open": "yes",
    "<div hidden><p>no, no, no</p></div><p>yes</p><div style='display: none'>no</div><div role=navigation>no</div>": "yes",
    "</p></div><p>x</b></p>": "x",
    "<p>a<div>b</div>c": "a\nb\nc",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<p>1 < 2 & 3 > 2</p>": "1 < 2 & 3 > 2",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    if CASES[html] is not None:
        assert hx.extract(html) == CASES[html]
    else:
        assert "good words" in hx.extract(html)


PARA = "<p>First words of it, which are many, and go on.</p><p>More words, and more, that matter.</p>"
FIRST = "First words of it, which are many, and go on.\nMore words, and more, that matter."


@pytest.mark.parametrize("name", "post-comments comment-content article-footer page-header main-menu entry-related story-share sidebarAd commentList".split())
@pytest.mark.parametrize("around", ["article", "div"])
def test_furniture_by_class(name, around):
    if name == "sidebarAd":
        assert hx.furniture("sidebarAd")
    block = f"<div class='{name}'><p>Leak, leak, and more leaks, as long as an article may be, or longer.</p></div>"
    assert hx.extract(f"<body><{around}>{PARA}</{around}>{block}</body>") == FIRST
    assert hx.extract(f"<body><{around}>{PARA}{block}</{around}></body>") == FIRST


def test_classes_that_name_what_is_beside():
    for name in ("has-sidebar", "post no-comments", "content with-ads", "category-social"):
        assert hx.extract(f"<body><div class='{name}'>{PARA}</div></body>") == FIRST
    assert hx.extract(f"<div class='sidebar'>{PARA}</div>") == FIRST  # nothing else is there
    assert hx.extract(f"<article class='post tag-social'>{PARA}</article><article class='comment-body'><p>c, c</p></article>") == FIRST


def test_all_of_an_article_is_kept():
    second = "<p>Second, and longer, and longer than the first, with commas, and commas</p>"
    plain = "Second, and longer, and longer than the first, with commas, and commas"
    assert hx.extract(f"<body><article>{PARA}</article><article>{second}</article></body>") == f"{FIRST}\n{plain}"
    assert hx.extract(f"<div><div>{PARA}</div><div>Short.</div><div>{second}</div><ul><li><a href=x>only a link</a></ul></div>") == f"{FIRST}\nShort.\n{plain}"
    assert hx.extract(f"<main><h1>T</h1><article>{PARA}</article></main>") == f"T\n{FIRST}"
    assert hx.extract("<div><div><p>" + "x" * 300 + "</p><p>" + "y" * 300 + "</p></div><p>z</p></div>") == "\n".join(["x" * 300, "y" * 300, "z"])


def test_letters_that_grow_in_lower_case():
    assert hx.extract("\u0130" * 60 + "<script>x = '<p>'</SCRIPT ><p>One, two</p><p>three</p>") == "\u0130" * 60 + "\nOne, two\nthree"


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<div>" + "<b>" * n + "<hr>" * n, lambda n: "<ul>" + "<div>" * n + "<li>x" * n, lambda n: '<a ">" ' * n, lambda n: "<a x" * n, lambda n: "<b><div>" * n + "</b>" * n, lambda n: "<p>" * n + "<span>" * n + "</p>" * n])
def test_time_follows_the_page(page):
    def took(n):
        html = page(n)
        began = time.process_time()
        hx.parse(html)
        return time.process_time() - began

    assert took(80_000) < 16 * max(took(10_000), 0.05)  # 64 and more if quadratic


def test_frame(spark):
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, None, "<p>x</p>", "t"), (3, None, "<p>x</p>", "t"), (4, "u", "<div>" * 3000 + "<p>deep, deep</p>", "t"), (5, "u", "<p>" + "word " * 50_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = hx.extract_main_text(df)
    assert out.columns == df.columns
    got = [(r.page_id, r.text) for r in out.orderBy("page_id").collect()]
    assert got == [(1, ""), (2, ""), (3, "x"), (3, "x"), (4, "deep, deep"), (5, ("word " * 50_000).strip())]
    assert hx.extract_main_text(df.limit(0)).count() == 0


def replica(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, length long, digest string")


def test_audit_finds_each_kind(spark):
    rows = [(f, o * 700, 700, f"d{f}-{o}") for f in range(5) for o in range(400)]
    bad = {(1, 700): "corrupt", (3, 0): "missing", (4, 399 * 700): "corrupt", (0, 20_300): "missing"}
    other = [(f, o, n, d + "x" if bad.get((f, o)) == "corrupt" else d) for f, o, n, d in rows if bad.get((f, o)) != "missing"] + [(9, 5, 1, "new")]
    a, b = replica(spark, rows), replica(spark, other)
    assert {(r.file, r.offset): r.status for r in wf.audit(a, b).collect()} == bad | {(9, 5): "extra"}
    assert wf.audit(a, a).count() == 0
    nothing = replica(spark, [])
    assert wf.audit(nothing, nothing).count() == 0
    assert wf.audit(a, nothing).count() == len(rows) == wf.audit(nothing, a).where("status = 'extra'").count()


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wf, "FILE_RECORDS", 3)
    rows = [(1, "http://a/é", "<p>é\r\n\r\nWARC/1.0</p>"), (1, "http://a/é", "<p>é\r\n\r\nWARC/1.0</p>"), (2, None, None), (3, "u", ""), (None, "n", "x" * 100_000), *[(i, f"u{i}", f"h{i}") for i in range(10, 20)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    recs = wf.records(pages)
    files = wf.pack(pages)
    got = wf.unpack(files)
    assert sorted((r.file, r.offset, r.length, r.digest) for r in recs.collect()) == sorted((r.file, r.offset, r.length, r.digest) for r in got.collect())
    assert sorted((r.uri, r.payload) for r in got.collect()) == sorted({(u or "", h or "") for _, u, h in rows})
    assert wf.audit(recs, got).count() == 0
    with pytest.raises(ValueError, match="offset 0"):
        list(wf.parse(b"junk"))
    content = bytes(files.first().content)
    with pytest.raises(ValueError, match="breaks off|no WARC"):
        list(wf.parse(content[:-30]))
    assert wf.records(pages.limit(0)).count() == 0


def test_query_on_repeated_and_null_ids(spark, tmp_path):
    """Which pages are changed and lost follows from their ids: each record's status is known beforehand."""
    rows = [(1, "u", "<p>a</p>"), (1, "v", "<p>b</p>"), (1, "u", "<p>a</p>"), (None, "n", "<p>null</p>"), (None, None, None), (7, "u", "<p>odd</p>"), (7, "w", None), (7, "x", "aba"), (11, "u", "<p>lost</p>"), (11, "v", "<p>too</p>"), *[(i, f"u{i}", f"<p>{i}</p>") for i in range(20, 200)]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.sha256, r.status) for r in queries.op5_warc_fixity(spark, str(tmp_path)).collect()]
    distinct = set(rows)
    assert len(got) == len(distinct) == len(set(got))

    def digest(i, url, html):
        raw = (html or "").encode()
        return hashlib.sha256(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(raw)}\r\n\r\n".encode() + raw + b"\r\n\r\n").hexdigest()

    def status(i, url, html):
        if i is not None and i % 97 == 11:
            return "missing"
        return "corrupt" if i is not None and i % 61 == 7 and html and html != html[::-1] else "intact"

    assert set(got) == {(i, digest(i, u, h), status(i, u, h)) for i, u, h in distinct}
