from __future__ import annotations

import random
from html.parser import HTMLParser

from lakescan.llm import html_text


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>menu</a></ul></nav>
<div class="ad-2 x">buy</div><div class="post post-{n}"><h1>T &amp; {n}</h1><p>a <b>b</b>c&#33;<p>d<br>e  f<ul><li>one<li>two</ul>
<script>var p="</p>"</script><form><input>q<button>go</button></form><div class="comments"><p>bad</div></div><aside>s</aside><footer>f</footer>"""
WANT = "T & {n}\na bc!\nd e f\none\ntwo"


def test_article_text(spark):
    rows = [(n, f"http://h.org/{n}", PAGE.replace("{n}", str(n))) for n in range(5)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.query(frame(spark, rows)).collect()}
    assert got == {n: (WANT.replace("{n}", str(n)), len(WANT.replace("{n}", str(n)))) for n in range(5)}


def test_hosts_agree_on_a_path(spark):
    article = "<body><div class=side><p>{long}</p></div><div class=main><p>text of {n}</p></div></body>"
    rows = [(n, "http://h.org/", article.replace("{n}", str(n) * 50).replace("{long}", "x" * (300 if n == 0 else 5))) for n in range(20)]
    got = {r.page_id: r.text for r in html_text.query(frame(spark, rows)).collect()}
    assert got[0] == "text of " + "0" * 50 and got[3] == "text of " + "3" * 50


def test_nulls_empty_pages_and_text_without_containers(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (None, None, "<p>x &lt;b&gt;"), (5, "http://z/", "plain\n text"), (5, "http://z/", "plain\n text")]
    got = [(r.page_id, r.text) for r in html_text.query(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, ""), (None, "x <b>"), (5, "plain text"), (5, "plain text")], key=str)


def test_empty_table_extra_columns_and_long_pages(spark):
    assert html_text.query(frame(spark, [])).count() == 0
    d = frame(spark, [(1, "http://a/", "<article>" + "<p>word word</p>" * 20_000 + "</article>")]).selectExpr("*", "1 AS host", "2 AS text")
    assert html_text.query(d).first().text == "\n".join(["word word"] * 20_000)


def article(page):
    return "\n".join(text for _, text, _ in html_text.blocks(page))


def test_words_inside_names_and_names_of_blocks_do_not_remove_them():
    page = '<body><div class="post category-social tag-advertising"><h2 id="related-work">Related</h2><p id=search-results>found<p class=banner>text</div>'
    page += '<div class="x comment-list"><p>no</div><ul id=share_buttons><li>no</ul><div class=ad-12>no</div>'
    assert article(page) == "Related\nfound\ntext"


def test_pictures_and_formulas_end_where_they_should():
    assert article('<div><p>a <svg class="icon"/> b</p><p>c</p></div>') == "a b\nc"
    assert article("<div><p>a <svg><title>t</title><text>no</text></svg>b</p></div>") == "a b"
    assert article("<div><svg><path><p>a</p><video><source></div><p>b") == "a\nb"
    assert article("<p>let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn><annotation encoding=tex>x</annotation></math> be") == "let x<2 be"


def test_every_template_of_a_host_gets_its_own_container(spark):
    rest = "<body><div class=tags><p>tag line</div>{}<div class=latest><p>latest list</div><div class=legal><p>copyright</div>"
    rows = [(n, "http://h.org/", rest.format(f"<article><p>{'text ' * 40}{n}</article>")) for n in range(90)]
    rows += [(90 + n, "http://h.org/", rest.format(f"<div class=page><div class=post-{'abcdefghij'[n]}><p>{'word ' * 40}{n}</div></div>")) for n in range(10)]
    got = {r.page_id: r.text for r in html_text.query(frame(spark, rows)).collect()}
    assert got == {n: "text " * 40 + str(n) for n in range(90)} | {90 + n: "word " * 40 + str(n) for n in range(10)}


def test_quotes_open_values_only():
    assert article("<p title=it's>Hello there</p><p>do not</p><p>don't stop</p>") == "Hello there\ndo not\ndon't stop"
    assert article("<p title='a > b' x=\"c > d\">one</p><p data-x = 'e > f'>two</p><p title=\"open>three</p>") == "one\ntwo\nthree"
    assert article("<p it's>one</p><!--><p>two</p><!-- <p>no</p> --><p class=a'b>three") == "one\ntwo\nthree"


def test_deep_nesting_takes_linear_work():
    deep = "<div>word" * 20_000
    found = list(html_text.blocks(deep))
    assert len(found) == 20_000 and html_text.extract("<body>" + deep, None).startswith("word")
    assert article("<b>" * 20_000 + "x" + "<p>y</i>" * 2_000).startswith("x\ny")


def made_pages(seed, n=60):
    """Pages with known article texts, as (page_id, url, html), and the texts: three hosts, each with templates of its own."""
    r = random.Random(seed)
    word = lambda: r.choice(["plain", "don't", "a<b", "é", "x & y", "©", "5 > 4", "tail"])
    escape = lambda s: s.replace("&", r.choice(["&amp;", "&#38;", "&#x26;"])).replace("<", "&lt;").replace(">", r.choice([">", "&gt;"]))
    spaces = lambda: r.choice([" ", "  ", "\n", "\t "])
    attribute = lambda: r.choice(["", " title=it's", " data-a='x > y'", ' lang="en"', " class=lead", " hidden-not"])
    rows, want = [], {}
    for i in range(n):
        host, template = r.randrange(3), r.randrange(2)
        parts, lines = [], []
        for _ in range(r.randint(3, 9)):
            tag = r.choice(["p", "p", "p", "h2", "ul", "blockquote"])
            text = [word() for _ in range(r.randint(8, 40))]
            inline = spaces().join(escape(w) if r.random() < 0.8 else f"<{t}{attribute()}>{escape(w)}</{t}>" for w in text for t in [r.choice(["b", "em", "span"])])
            parts.append(f"<ul><li{attribute()}>{inline}</ul>" if tag == "ul" else f"<{tag}{attribute()}>{spaces()}{inline}" + ("" if tag == "p" and r.random() < 0.5 else f"</{tag}>"))
            lines.append(" ".join(text))
        body = "".join(parts)
        main = [f"<article class=a{i}>{body}</article>", f"<div class='entry e-{i}'>{body}</div>"][template] if host < 2 else f"<table><tr><td class=text>{body}</table>"
        side = r.choice(["<aside><p>more</aside>", "<div class=sidebar><p>older texts</p></div>", "<div id='cookie-notice'><p>we use them</p></div>", "<form><p>ask</form>", "<div class='comments'><p>first!</div>", "<script>if (a < b) '</p>'</script>"])
        rows.append((i, f"http://h{host}.org/{i}", f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><a href=/>home</a></nav><header>top</header>{side}{main}{side}<footer>end</footer></body></html>"))
        want[i] = "\n".join(lines)
    return rows, want


def test_known_articles_come_back_whole(spark):
    for seed in (1, 2):
        rows, want = made_pages(seed)
        got = {r.page_id: r.text for r in html_text.query(frame(spark, rows)).collect()}
        assert got == want


def test_raw_elements_hold_no_markup():
    assert article('<body><script>var s="<!--";</script><article><p>Hello there</p></article></body>') == "Hello there"
    assert article("<title>a <!-- b</title><p>one</p><!-- <script> --><p>two</p><style>/* <!-- */</style>three") == "one\ntwo\nthree"
    assert article("<p>a<textarea><!-- </textarea>b<iframe><p <!-- </iframe>c<![CDATA[ <!-- ]]>d</p>e") == "a b c <!-- d\ne"
    assert article('<script>if (a<b) "</p>"; "<![CDATA["</script ><p>x<script>never closed <p>y') == "x"


def test_a_form_around_a_page_is_no_form():
    page = "<body><form action=/><div class=main><p>{}</div></form><form><p>ask</form></body>"
    assert article(page.format("word " * 50)) == ("word " * 50).strip()
    assert article("<body><p>" + "word " * 50 + "<form><p>ask me</form>") == ("word " * 50).strip()
    assert article("<body><p>" + "word " * 9 + "<form class='" + "x" * 200 + "'><p>ask</form>") == ("word " * 9).strip()
    found = {}
    assert [box in found for box, _, _ in html_text.blocks(page.format("word " * 50), found)] == [True]


class Independent(HTMLParser):
    """Blocks by the standard library's parser, for pages whose elements are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.never, self.raw = [], [], 0, 0

    def flush(self):
        if line := " ".join("".join(self.text).split()):
            self.out.append(line)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.flush()
        self.never += tag in html_text.NEVER
        self.raw += tag in html_text.RAW

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.flush()
        self.never -= tag in html_text.NEVER
        self.raw -= tag in html_text.RAW

    def handle_data(self, data):
        if not self.never and not self.raw:
            self.text.append(data)


def test_equals_an_independent_parser_on_pages_with_scripts_and_comments():
    r = random.Random(3)
    piece = lambda: r.choice(["plain", "a &lt; b", "&amp;", "é", "5 &gt; 4", "<b>bold</b>", "<!-- no -->", "<!-- <p> -->", "<script>x = '<!--'</script>", "<style>p > a {}</style>", "<script>if (a < b) {}</script>", "<!---->", "<i>it's</i>"])
    for _ in range(400):
        page = "<html><head><title>a b</title></head><body>"  # the other parser takes comments in titles for such
        for _ in range(r.randrange(1, 8)):
            tag = r.choice(["p", "h2", "div", "section", "nav", "aside", "blockquote", "article"])
            page += f"<{tag}>" + " ".join(piece() for _ in range(r.randrange(9))) + f"</{tag}>" + r.choice(["", " tail ", "<!-- - -->"])
        page += "</body></html>"
        own = Independent()
        own.feed(page)
        own.close()
        own.flush()
        assert article(page) == "\n".join(own.out), page
