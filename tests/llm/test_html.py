"""The page parser, and template removal on the given pages."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html


def text(page):
    return html.Page(page).text()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Before <a title=it's>link one</a> after.</p><p>Second, don't drop.</p>", "Before link one after.\nSecond, don't drop."),
        ("<p>an <span class=ad-hoc>ad-hoc</span> word</p><div class='related-work'>Related work</div>", "an ad-hoc word\nRelated work"),
        ("<div class='content no-sidebar'><p>kept</p></div><div id='page' class='has-header'>as well</div><div class='ad-free'>free</div>", "kept\nas well\nfree"),
        ("<div class='cookie-notice'>gone</div><div class='site_footer'>gone</div><div class='x sidebar'>gone</div><p>kept</p>", "kept"),
        ("<form action=/p><div><p>a page in one form, with its text</p></div><input></form>", "a page in one form, with its text"),
        ("<div class='right-sidebar'><article><p>held</p></article><p>beside</p></div>", "held"),
        ("<p>text</p><form><p>ask</p></form>", "text"),
        ("<p a=b\"c>one<p x='>'>two</p><p y=\"unclosed", "one\ntwo"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e</table>", "a\nb\nc\nd\ne"),
        ("<article><p>x</p><section class=comments><article class=comment>y</article></section></article>", "x"),
        ("a < b <p>c &amp; d</p>", "a < b\nc & d"),
    ],
)
def test_parser(page, want):
    assert text(page) == want


def test_stray_and_open_tags_take_linear_time():
    start = time.time()
    assert text("<p>" + "<b>x" * 50_000 + "</i>y" * 50_000) == ("x" * 50_000) + ("y" * 50_000)
    text("<div>" * 50_000 + "</p></span>" * 50_000)
    text("<p a=" + "b'c " * 50_000)
    text("<a " + "x=" * 100_000)
    assert time.time() - start < 5


def test_templates_decide_on_the_given_pages(spark, sf_dir):
    """Without roles and marks, template removal alone changes the given pages, exactly as counted by brute force."""
    pages = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.1/pages.parquet").filter("url like '%example.net/%'")
    rows = {r.page_id: (r.url, r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.main_texts(pages, roles=False).collect()}
    seen, parsed = defaultdict(set), {}
    for i, (url, source) in rows.items():
        host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
        page = html.Page(source or "")
        parsed[i] = html.groups_of(host)
        for g in parsed[i]:
            for h in {*page.subtrees.values()}:
                seen[g, h].add("\n".join(b for _, b in page.blocks))
    pages_of = defaultdict(set)
    for i, gs in parsed.items():
        for g in gs:
            pages_of[g].add(rows[i][1])
    often = {k for k, v in seen.items() if len(v) >= html.MIN_PAGES and len(v) >= html.MIN_SHARE * len(pages_of[k[0]])}
    plain = {i: html.Page(source or "", roles=False).text() for i, (_, source) in rows.items()}
    changed = sum(got[i] != plain[i] for i in rows)
    assert changed > 0.5 * len(rows)
    for i, gs in parsed.items():  # no element goes that doesn't recur; nearly all that recur go (copies stay)
        page = html.Page(rows[i][1] or "", roles=False)
        most = page.text(lambda h, gs=gs: any((g, h) in often for g in gs))
        assert set(most.split("\n")) <= set(got[i].split("\n")) <= set(plain[i].split("\n")) | {""}
    same = sum(got[i] == html.Page(rows[i][1] or "", roles=False).text(lambda h, gs=gs: any((g, h) in often for g in gs)) for i, gs in parsed.items())
    assert same > 0.95 * len(rows)


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/", "<p>x</p>")], "page_id long, url string, html string")
    for name in ("text", "N_chars", "host", "path", "_known"):
        with pytest.raises(ValueError, match=name.lower()):
            html.main_texts(pages.withColumn(name, F.lit(1)))
    row = html.main_texts(pages.withColumns({c: F.lit(7) for c in ("group", "item", "page", "own", "n")})).first()
    assert (row.text, row.group, row.own, row.n) == ("x", 7, 7, 7)
