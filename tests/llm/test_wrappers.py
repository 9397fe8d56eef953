import html
import re

from pyspark.sql import functions as F

from strideframe.llm import wrappers


def page(i, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home {i}</a></li><li>x</li></ul></nav>'
        f'<div class="ad">Buy {i}</div><article><h1>Title {i}</h1>{body}<p class="share">Share</p></article>{extra}<footer>&copy; f{i}</footer></body></html>'
    )


def test_blocks_entities_and_boilerplate():
    source = page(
        1, '<p>One &amp; two<br>three <b>b</b>old</p><script>var t="</p><p>no</p>";</script><p>Open <i>p</i><p>Next&nbsp;&#233; &lt;x&gt;</p><!-- <p>gone</p> -->'
        '<form><p>Mail?</p><input></form><div class="comments"><p>Nice post</p></div><aside>side</aside><div id="cookie-notice">Cookies</div>'
        "<ul><li>a</li><li>b  c</li></ul>tail", "<p>outside</p>"
    )
    got = wrappers.Extractor(None).text(source)
    assert got == "Title 1\nOne & two three bold\nOpen p\nNext é <x>\na\nb c\ntail"


def test_wrapper_folds_repeats_and_drops_template_text():
    pages = [page(i, "".join(f"<p>text {i} {j}</p>" for j in range(i))) + "" for i in range(1, 8)]
    pages = [p.replace('<p class="share">Share</p>', "<div>Read more</div>") for p in pages]
    found = wrappers.infer([wrappers.read_page(p) for p in pages])
    names = [e[0] for e in found["expression"]]
    assert "(p # /p)+" in names and "(li # /li)+" in names and list(found["constant"].values()) == ["Read more"]
    assert wrappers.Extractor(found).text(pages[3]) == "\n".join(["Title 4", *[f"text 4 {j}" for j in range(4)]])


def test_optional_groups_and_pages_without_article():
    def plain(i):
        quote = "<blockquote>quoted words, long enough to count as part of the main text of this page here, yes</blockquote>" if i % 2 else ""
        return f"<body><div class='menu'><p>menu</p></div><div class='x'>{'long text of page %d ' % i * 12}</div>{quote}<div class='y'>by {i}</div></body>"

    found = wrappers.infer([wrappers.read_page(plain(i)) for i in range(6)])
    assert ["blockquote", True] in found["expression"]
    got = wrappers.Extractor(found).text(plain(9))
    assert got.startswith("long text of page 9") and "quoted" in got and "menu" not in got and "by 9" not in got


def test_plain_pages_of_a_mixed_host_are_whole():
    """An article mark on one page says nothing about the others; short blocks and places without evidence stay."""
    plain = "<body><div class='menu'>menu</div><h1>Old title</h1><div>Short first.</div><div>by A</div><p>Last line.</p><div id='cookie-content'>Cookies</div></body>"
    want = "Old title\nShort first.\nby A\nLast line."
    rest = [page(i, f"<p>text {i}</p>") for i in range(5)]
    for sample in ([], rest, [*rest, plain], [plain] * 3):
        assert wrappers.Extractor(wrappers.infer([wrappers.read_page(p) for p in sample])).text(plain) == want
    assert wrappers.Extractor(None).text("<div>few</div><div>words</div><nav>menu</nav>") == "few\nwords"
    # An article block at a place that was never sampled, or was boilerplate there, is kept by its own mark.
    fitted = wrappers.Extractor(wrappers.infer([wrappers.read_page(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in rest]))
    assert fitted.text(page(9, "<p>a</p><h2>b</h2><div>c</div>")) == "Title 9\na\nb\nc"


def test_broken_markup_ends_with_the_page():
    for source in (None, "", "<", "<p", "<!-- open <p>x</p>", "<script>x", "plain", "<p>a<p>b", "</p></div>x", "<a title='x>y'>z</a>" * 3, "<p>" * 3000):
        assert isinstance(wrappers.Extractor(None).text(source), str)


def test_query_on_pages(spark):
    from strideframe.llm.queries import QUERIES

    sources = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = QUERIES["op2_html_extraction"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(sources)
    for r in got:
        body = re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages_and_joined_wrappers(spark, monkeypatch):
    rows = [(1, None, None, "q"), (2, "http://h/a", "", "q"), (2, "http://h/a", "", "q"), (None, "http://h/b", page(3, "<p>x</p>"), "q"), (4, "no url", page(4, "<p>" + "y " * 9000), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {(r.page_id, r.text) for r in wrappers.main_text(pages).collect()}
    assert (None, "Title 3\nx") in want and (1, "") in want and wrappers.main_text(pages).count() == 5
    monkeypatch.setattr(wrappers, "WRAPPER_BYTES", -1)
    assert {(r.page_id, r.text) for r in wrappers.main_text(pages).collect()} == want
    assert wrappers.main_text(pages.where(F.lit(False))).count() == 0


def test_standing_blocks_of_articles_stay_and_constants_hold_on_every_page(spark, monkeypatch):
    """What every article of a host has is part of it; template text of plain pages is settled over all pages of the host."""
    def article(i, name):
        return page(i, f"<h2>Summary</h2><div>By the staff</div><p>text {name}</p>").replace(f"Title {i}", "Daily news")

    def plain(i, note="All rights belong to the owners of this site."):
        return f"<body><div class='m'><p>{note}</p></div><div class='x'>{f'long text of page {i} ' * 12}</div></body>"

    copy = "<body><div class='x'>{}</div><div class='y'>the same article on every page</div></body>"
    rows = [(i, "http://a/x", article(i, i)) for i in range(30)] + [(100 + i, "http://b/x", plain(i)) for i in range(200)]
    rows += [(400 + i, "http://c/x", plain(i, "Only here." if i == 77 else "On all but one page.")) for i in range(200)]
    rows += [(700 + i, "http://d/x", copy.format(f"ad {i}")) for i in range(30)]
    rows += [(800 + i, "http://e/x", article(i, "copied")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (wrappers.WRAPPER_BYTES, -1):
        monkeypatch.setattr(wrappers, "WRAPPER_BYTES", size)
        got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
        assert all(got[i] == f"Daily news\nSummary\nBy the staff\ntext {i}" for i in range(30))
        assert all(got[100 + i] == f"long text of page {i} " * 11 + f"long text of page {i}" for i in range(200))
        assert all(got[400 + i].startswith("Only here." if i == 77 else "On all but one page.") for i in range(200))
        assert all("the same article on every page" in got[700 + i] for i in range(30))
        assert all(got[800 + i] == "Daily news\nSummary\nBy the staff\ntext copied" for i in range(30))


def test_wrappers_decide_on_a_host_without_any_marks(spark):
    """Bare divs alone: menu, adverts and footer recur at their place, title and paragraphs don't; without wrappers all stays."""
    def bare(i):
        parts = ["Home", "News", "Contact", f"Buy the cheap shoes number {i % 5} now", f"Title of {i}", *(f"paragraph {k} of page {i}, " * 9 for k in range(2 + i % 3))]
        return "<body>" + "".join(f"<div>{x}</div>" for x in [*parts, "Imprint and terms of use"]) + "</body>"

    def article(i):
        return "\n".join([f"Title of {i}", *((f"paragraph {k} of page {i}, " * 9).strip() for k in range(2 + i % 3))])

    pages = spark.createDataFrame([(i, "http://bare/x", bare(i)) for i in range(60)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    assert got == {i: article(i) for i in range(60)}
    assert all(x in wrappers.Extractor(None).text(bare(3)) for x in ("Home", "number 3 now", "Imprint"))


def test_only_whole_names_tell():
    inside = "<div class='share-price'>a</div><h3 class='notice'>b</h3><section id='related-work'><p>c</p></section><h2 id='search'>d</h2>"
    lost = "<div class='comment-list'>e</div><div id='site-footer'>f</div><div class='advert top-2'>g</div><nav>h</nav>"
    assert wrappers.Extractor(None).text(f"<article>{inside}{lost}</article><p class='copyright'>i</p>") == "a\nb\nc\nd"
    assert wrappers.Extractor(None).text(f"<body><h2 id='search'>d</h2><p id='form'>k</p>{lost}</body>") == "d\nk"
