"""Text rules against plain Python."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from sieveframe.functions import text as X
from sieveframe.functions.names import slug


class Visible(HTMLParser):
    """What a page shows, told by events."""

    def __init__(self):
        super().__init__()
        self.out, self.depth = "", 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style") and self.depth > 0
        self.out += "\n" * (tag in ("p", "div", "tr", "br"))

    def handle_data(self, data):
        self.out += "" if self.depth else f"{data} "


def visible(page):
    parser = Visible()
    parser.feed(page)
    return parser.out


def test_html_text(evaluate):
    pages = [
        "<p>a &amp; b</p>tail", "<div title='x>y'>k</div><br/>z<br>w", "a<!-- <p>no</p> -->b", "<SCRIPT>var t='</p>'</SCRIPT>ok",
        "<style>p{}</style><td>1</td><td>2</td></tr>", "&lt;p&gt; &#233; &#xE9; &eacute; &nbsp;| &unknown; a & b &amp;lt; ",
        "<p title=don't>it's</p>x", "plain > text < 5", "<p\nclass='a'>n</p\n>", "<pre>no line</pre><param/>e", "", "&#x1F600; &apos;"]
    assert evaluate(X.html_text, pages) == [visible(p) for p in pages]


def test_html_text_of_provided_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in pages.select("html", X.html_text(F.col("html")).alias("text")).collect():
        assert row["text"] == visible(row["html"])


def test_long_tags_and_runs_do_not_overflow(evaluate):
    page = "<a " + "x='1' " * 500 + ">" + "word " * 50000 + "</a>" + "<p>&amp;</p>" * 2000
    assert evaluate(X.html_text, [page]) == [visible(page)]


def test_slug_matches_names(evaluate):
    values = ["Preço (R$)", " Ação_1 ", "", "ß", "Ǻngström", "ｆｕｌｌ", "日本", "a--b", "São Paulo/SP"]
    assert evaluate(X.slug_col, values) == [slug(v) for v in values]


def test_links(evaluate):
    values = ["see (https://a.b/c?d=1).", "no link", "http://x, then", "ftp://x https://y).,", "https://a\xa0b"]
    assert evaluate(X.first_link, values) == ["https://a.b/c?d=1", "", "http://x", "https://y", "https://a"]


def test_url_policy(evaluate):
    good = ["http://a.b", "HTTPS://a.b:443/x", "http://a:80?q", "http://a:", "http://[::1]:80/", "http://a/b@c", "http://@a/"]
    bad = ["ftp://a", "http://", "http://u@a", "http://u:p@a", "http://a:8080", "//a", "a.b", "http://a:x", "http://:p@a/"]
    assert evaluate(X.url_ok, good + bad) == [True] * len(good) + [False] * len(bad)


def test_file_kind(evaluate):
    urls = ["https://a/b/c.CSV?x=.pdf", "https://a.com/", "x/y.tar.gz", "https://a/%2Exlsx", "https://a/n%2Exlsx", ".csv", "f.parquet#p"]
    kinds = evaluate(lambda u: X.file_kind(u, F.lit("application/pdf")), urls)
    assert kinds == [".csv", ".pdf", ".pdf", ".pdf", ".xlsx", ".pdf", ".parquet"]
    assert evaluate(lambda u: X.file_kind(u, F.lit("image/png")), ["x"]) == [".txt"]


def test_commands(evaluate):
    texts = ["/review", "/CSREVIEW now", "/decimais@Bot x br_para_us", "/arrumar@other", "arrume tudo", "", "please /arrumar", "/"]
    assert evaluate(lambda t: X.command(t, "bot"), texts) == [
        "diagnostico", "arrumar", "pontuacao", None, "", "", "", ""]


def test_requests(evaluate):
    texts = ["/separador tab", "/separador adivinhe", "/separador", "/pontuacao valor br_para_us", "/pontuacao", "/arrumar tudo",
             "/arrumar https://a/b.csv", "/desconhecido", "hello"]
    found = evaluate(lambda t: X.request(t), texts)
    assert [r["accepted"] for r in found] == [True, False, False, True, False, False, True, False, False]
    assert found[0]["delimiter"] == "\t" and (found[3]["column"], found[3]["direction"]) == ("valor", "br_to_us")
