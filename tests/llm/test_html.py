import random
import time
from html.parser import HTMLParser

from lumora.llm import html


def text(source, template=()):
    return html.Page(source).text(set(template))


def test_pages():
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One<br>two.<p>Three &#233;&nbsp;\n four</p><div class="comments"><p>me too</p></div></article><footer>&copy; f</footer>'
    assert text(page) == "Head & more\n\nOne two.\n\nThree é four"
    assert text("<p>a < b && c<p>d<li>e<li>f") == "a < b && c\n\nd\n\ne\n\nf"
    assert text("just text") == "just text" and text("") == "" and text("<article></article>") == ""
    assert text("<header>site</header><main><header>h</header><form>q<input></form>x<aside>s</aside></main>") == "h\n\nx"
    assert text("<article><p>a</article><article class='comment'>c</article>") == "a"
    assert text("<p>" * 3000 + "deep") == "deep" and text("<div>" * 3000 + "deep") == "deep"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>").split("\n\n")[-1] == "c"


def test_template(spark):
    body = lambda i: f"<body><div><p>Site words {i % 2 * 0}</p></div><article><p>Same line</p><p>text {i}</p><div>Read <a>more</a></div></article><p>own {i}</p></body>"
    plain = lambda i: f"<body><div>Boxed template</div><p>text {i}</p></body>"
    rows = [(i, f"http://a.example/{i}", body(i), 1) for i in range(40)] + [(100 + i, f"http://b.example:80/{i}", plain(i), 1) for i in range(40)]
    rows += [(200, None, None, 1), (201, "x", "", 1), (None, "http://c.example", plain(1), 1), (203, "http://c.example", "w " * 100_000, 1), (3, "http://a.example/3", body(3), 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[3] == "Same line\n\ntext 3" and by[103] == "text 3" and by[200] == by[201] == ""
    assert by[None] == "Boxed template\n\ntext 1" and len(by[203]) == 199_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    long = "".join(f"<p>Sentence {k} of the article.</p>" for k in range(30))
    want = "\n\n".join(f"Sentence {k} of the article." for k in range(30))
    box = "<div>Read <a>more</a></div>"
    wrapped = lambda own: f"<body><article><div>{long}</div>{own}</article></body>"
    rows = [(i, f"http://a.example/{i}", wrapped("")) for i in range(50)]  # equal pages
    rows += [(100 + i, f"http://b.example/{i}", wrapped(f"<p>copy {i}</p>{box}")) for i in range(50)]  # equal but for a line
    rows += [(200 + i, f"http://c.example/{i}", f"<body><div>{long}</div></body>") for i in range(50)]  # without article
    rows += [(300 + i, f"http://d.example/{i}", f"<article><div>{long}</div></article>" if i % 2 else f"<article><p>{'own words ' * 9}{i}</p>{box}</article>") for i in range(60)]
    by = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == want and by[200 + i] == want for i in range(50))
    assert all(by[100 + i] == f"{want}\n\ncopy {i}\n\nRead more" for i in range(50))
    assert by[301] == want and by[300] == f"{'own words ' * 9}0"


class Reference(HTMLParser):
    """The text of well-formed pages, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], ""

    def flush(self):
        self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
            return
        if tag in html.BLOCK:
            self.flush()
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        if "article" in self.stack and not {"nav", "aside", "form", "script", "style", "footer"} & set(self.stack):
            self.now += data

    def text(self):
        self.flush()
        return "\n\n".join(b for b in self.blocks if b)


def test_equals_another_parser_on_random_pages():
    r = random.Random(6)

    def inline(depth):
        return "".join(r.choice(["word ", "a &amp; b ", "&eacute;&#x41; ", "x<br>y", "1 < 2 ", " \n\t ", f"<b>{inline(depth - 1)}</b>" if depth else "z", f"<a href='/q?a=\">'>{inline(depth - 1)}</a>" if depth else "z"]) for _ in range(r.randint(0, 4)))

    def block(depth):
        kinds = ["p", "h2", "div", "section", "ul", "nav", "aside", "form", "script", "footer"]
        t = r.choice(kinds if depth else ["p", "h2"])
        if t in ("p", "h2"):
            return f"<{t} class='share and search of notices'>{inline(2)}</{t}>"
        if t == "script":
            return "<script>if (a < b) document.write('<p>no</p>')</script>"
        return f"<{t}>" + "".join(f"<li>{inline(1)}</li>" if t == "ul" else block(depth - 1) for _ in range(r.randint(0, 3))) + f"</{t}>"

    for _ in range(300):
        page = f"<html><head><title>t</title></head><body><nav>n</nav>{block(1)}<article>{''.join(block(3) for _ in range(r.randint(0, 5)))}</article><footer>f</footer></body></html>"
        page = page.replace("class='share and search of notices'", "class='searching-for-notices'")
        other = Reference()
        other.feed(page)
        assert text(page) == other.text()


def test_time_is_linear_in_broken_pages():
    for part in ("<a ", "<a \"", "<a '\">", "<!", "<!--", "<script", "<div>", "<span>", "</x>", "<p><span>", "<a '' \"\"", "<li><b>", "&", "<td><i>", "<a \">\" "):
        page = "<article><p>begin</p>" + part * (1_000_000 // len(part))
        began = time.perf_counter()
        assert text(page).startswith("begin")
        html.Page(page).subtrees()
        assert time.perf_counter() - began < 20, part
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000
    assert text(deep) == "x"


def test_names_inside_articles():
    keep = "<article><p class='research-notice-of-intent'>a</p><div class='search-history'>b</div><div class='ad'>c</div><div id='share-buttons'>d</div><div class='related-list x'>e</div></article>"
    assert text(keep) == "a\n\nb"
