import html
import random
from html.parser import HTMLParser

from webrel.llm import mainpage


class Plain(HTMLParser):
    """Blocks inside ``article`` by the standard parser, for the test tables' markup."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.parts, self.out = False, [], []

    def flush(self):
        t = " ".join(html.unescape("".join(self.parts)).split())
        self.parts = []
        self.out += [t] if t else []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1"):
            self.flush()
        elif tag == "br" and self.inside:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data("&" + name + ";")

    def handle_charref(self, name):
        self.handle_data("&#" + name + ";")


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["id"]: r["text"] for r in mainpage.extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r["html"].replace("&am<", "&amp;am<").replace("&a<", "&amp;a<").replace("&amp<", "&amp;<"))
        p.flush()
        assert got[r["page_id"]].replace(" ", "") == "\n".join(p.out).replace(" ", "")


def page(main, menu="Home About", foot="Imprint"):
    return f"<html><body><div>{menu}</div><table><tr><td>Site of many things</table>{main}<div>{foot}</div></body></html>"


def test_differencing_removes_shared_lines(spark):
    rows = [(1, "http://h/a/1", page("<p>First &eacute;</p><p>Text  one</p>")), (2, "http://h/a/2", page("<p>Second</p>")),
            (3, "http://h/b/1", page("<p>Third</p><p>First &eacute;</p>")), (4, "http://other/x", page("<p>Alone</p>")),
            (5, "no url", page("<p>Nowhere</p>")), (6, None, page("<p>None</p>")), (7, "http://h/a/3", None), (8, "http://t/1", page("<p>Same</p>")),
            (9, "http://t/2", page("<p>Same</p>")), (1, "http://h/a/1", page("<p>First &eacute;</p><p>Text  one</p>"))]
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id bigint, url string, html string, text string, rid string")
    got = mainpage.extract(df).collect()
    assert len(got) == len(rows)
    text = {r["id"]: r["text"] for r in got}
    menu = "Home About\nSite of many things\n"
    assert text[1] == "First é\nText one" and text[2] == "Second" and text[3] == "Third\nFirst é"
    assert text[4] == menu + "Alone\nImprint" and text[5] == menu + "Nowhere\nImprint" and text[6] == menu + "None\nImprint"
    assert text[7] == "" and text[8] == text[9] == menu + "Same\nImprint"
    assert mainpage.extract(df.limit(0)).count() == 0


def test_marked_pages_are_differenced(spark):
    def marked(own, quote="<p>As they said</p>", around="article"):
        return page(f"<{around}><h1>{own}</h1>{quote}<div>Sign up for our letter</div></{around}>")

    notice = "<div>All that this long notice of the site says stands on every page</div>"
    rows = [(1, "http://h/a/1", marked("One")), (2, "http://h/a/2", marked("Two")), (3, "http://h/a/3", marked("Three", "<div>As they <p>said</p></div>")),
            (4, "http://m/1", marked("One", around="main")), (5, "http://m/2", marked("Two", around="main")), (6, "http://alone/1", marked("One")),
            (7, "http://d/1", page("<article><div>As they said</div><div>One</div></article>")),
            (8, "http://d/2", page("<article><div>As they said</div><div>Two</div></article>")),
            (9, "http://n/1", page(f"<main>{notice}<article><p>One</p></article></main>")),
            (10, "http://n/2", page(f"<main>{notice}<article><p>Two</p></article></main>")),
            (11, "http://u/1", page("<p>One</p>")), (12, "http://u/2", marked("Two")), (13, None, marked("One")),
            (14, "http://s/1", marked("Same")), (15, "http://s/2", marked("Same")), (1, "http://h/a/1", marked("One"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = mainpage.extract(df).collect()
    assert len(got) == len(rows)
    text, letter = {r["id"]: r["text"] for r in got}, "\nSign up for our letter"
    assert text[1] == "One\nAs they said" and text[2] == "Two\nAs they said" and text[3] == "Three\nAs they\nsaid"   # quoted in prose, the letter bare
    assert text[4] == "One\nAs they said" and text[5] == "Two\nAs they said"
    assert text[6] == text[13] == "One\nAs they said" + letter and text[14] == text[15] == "Same\nAs they said" + letter
    assert text[7] == "As they said\nOne" and text[8] == "As they said\nTwo"     # an article without prose
    assert text[9] == "One" and text[10] == "Two"                                   # what is shared does not outweigh the article
    assert text[11] == "One"                                                        # a marked neighbour tells the menu too


def test_furniture_inside_the_article():
    assert mainpage.article("""<article><header><h1>T</h1></header><nav>n</nav><p>a<p class="ad big">no<p>b &lt;c&gt;
        <form><input>f</form><aside>s</aside><div id="comments"><p>c1</p></div><script>"<p>x</p>"</script>
        <ul><li>one<li>two</ul><div class="cookie-notice">k</div><footer>f</footer><p>end""") == ["T", "a", "b <c>", "one", "two", "end"]
    assert mainpage.article("") == [] and mainpage.article("<p>x") is None
    assert mainpage.article("<main>m<article></article></main>") == ["m"]


def test_common_is_a_longest_subsequence():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got, it = mainpage.common(a, b), iter(b)
        assert len(got) == table[-1][-1] and all(any(a[k] == y for y in it) for k in got)


def test_only_whole_attributes_tell_furniture():
    for kept in ('<a href="/hidden/x">', '<p style="overflow:hidden">', '<span aria-hidden="false">', '<a title="a hidden valley">',
                 '<a href="/p?id=ad">', '<p data-role="banner">', '<p data-id=ad>', '<div class="no-sidebar">', '<div class="entry-header">',
                 '<div hidden="until-found">'):
        assert mainpage.article(f"<article>a {kept}b") in (["a b"], ["a", "b"]), kept
    for gone in ("<div hidden>", "<div hidden=hidden>", '<span aria-hidden="true">', "<div role='banner'>", '<div id = "ad">', "<div class=x-menu>",
                 '<div class="menu-item-has-children">', '<div class="comment-header">'):
        assert mainpage.article(f"<article>a {gone}b") == ["a"], gone


def test_layout_around_the_article_is_no_furniture():
    for around in ("layout no-sidebar", "layout sidebar-left", "page-header-fixed", "has-right-sidebar"):
        assert mainpage.article(f'<div class="{around}"><div class="menu">m</div><article><p>a</article></div>') == ["a"], around
        assert mainpage.article(f'<div class="{around}"><div class="x-menu">m</div><main><p>a</main></div>') == ["a"], around
    assert mainpage.article('<article>a</article><div class="left-sidebar"><article>t</article></div>') == ["a"]
    assert mainpage.article('<p>a<div class="related-posts"><article>t</article></div>') is None
    assert mainpage.article('<nav><div class="x-menu"><article>t</article></div></nav><article>a</article>') == ["a"]


def test_names_of_the_subject_are_no_furniture():
    for kept in ('class="share-of-market"', 'class="related-work"', 'class="notice-period"', 'id="comments-on-kant"', 'id="social-policy"',
                 'class="x banner-of-the-realm"'):
        assert mainpage.article(f"<article><p>a</p><div {kept}>b</div></article>") == ["a", "b"], kept
    for gone in ("share-buttons", "cookie-notice", "post-related", "ad_slot", "newsletter-signup-box", "sharing", "c-social"):
        assert mainpage.article(f'<article><p>a</p><div class="{gone}">b</div></article>') == ["a"], gone


def test_main_beside_teasers():
    text = "<p>The long text of the page.</p>"
    assert mainpage.article(f"<main>{text}<article>teaser</article></main>") == ["The long text of the page."]
    assert mainpage.article(f"<main>{text}<article>{text * 2}</article></main>") == ["The long text of the page."] * 2
    assert mainpage.article(f"<main>Intro<article>{text}</article></main>") == ["The long text of the page."]
