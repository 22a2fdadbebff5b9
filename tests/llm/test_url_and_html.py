import html
import re

from casegrid.llm import url_filter
from casegrid.llm.html_text import extract, main_text
from casegrid.llm.queries import URL_RULES
from tests.llm import edges


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[2]) if best else (host, path, None, "allow")


URLS = [
    "https://a.b.example.net/en/x", "http://example.net", "http://example.net/", "http://EXAMPLE.net/en", "http://badexample.net/en/",
    "https://x.example.com/de/1?u=http://y.net/", "https://x.example.com#/de/", "https://x.example.com?/de/", "ftp://org/fr/", "http://a.org/fr/q#f",
    "http://a.org/de/", "no scheme net/", "http://", "http:///net/", "http://net./", "http://a..net/", "http://user@a.net:80/", "", None, "x://y://z.net/",
    "http://é.example.net/EN/", "http://a.net/" + "p/" * 5000, "http://a.net\n/x", "http://a.net/x", "http://a.net/x",
]


def test_verdicts_equal_brute_force(spark):
    extra = [("allow", "a.net", "/p/p/"), ("block", "a.net", "/p/p/"), ("allow", "b.a.net", ""), ("block", "A.NET", "/x"), ("block", None, "/"), ("allow", "net", None)]
    pages = spark.createDataFrame([(i, u, "host", "verdict") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    for rules in (URL_RULES, URL_RULES + extra):
        whole = [(v, lowered(h), p) for v, h, p in rules if h is not None and p is not None]
        made = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.SCHEMA)).collect()}
        for i, url in enumerate(URLS):
            assert made[i] == judged(url, whole), url
    none = url_filter.judge_urls(pages, spark.createDataFrame([], url_filter.SCHEMA)).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(URLS)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, url_filter.SCHEMA)).count() == 0


def test_native_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string").cache()
    made = url_filter.judge_urls(pages, spark.createDataFrame(URL_RULES, url_filter.SCHEMA).cache())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r.html for r in pages.collect()}
    made = extract(pages).collect()
    assert len(made) == len(whole)
    for r in made:
        inner = re.search(r"<article>(.*?)</article>", whole[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r.text == want and r.n_chars == len(want)


LONG = "This sentence is part of a long article about rivers and boats, and it goes on for a while. "


def test_parts_that_are_not_the_article():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>
    <header class="site-header"><a href=/>Home</a></header><div id="cookie-notice">We use cookies <button>OK</button></div>
    <nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
    <div class="wrap"><div class="sidebar"><p>{LONG}</p></div>
    <main><h1>Title &amp; more</h1><p>{LONG}<b>bo</b>ld&nbsp;text<br>next &lt;tag&gt;<p>{LONG * 3}
    <div class="ad-slot ad">Buy now</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form><input value=x>Sign</form>
    <script>if (a < b) {{ document.write("<p>no</p>") }}</script><!-- <p>hidden</p> -->
    <section id="comments"><p>{LONG}</p></section></main></div><footer>Imprint</footer></body></html>"""
    body = " ".join(LONG.split())
    assert main_text(page) == f"Title & more {body} bold text next <tag> {body} {body} {body} one two c1 c2"


def test_broken_and_odd_pages(spark):
    assert main_text("just text") == "just text"
    assert main_text("<p>a<p>b") == "a b"
    assert main_text("<html><body><nav>x</nav></body></html>") == ""
    assert main_text("<body><article><p>cut off here &am") == "cut off here &am"
    assert main_text("<div>" * 30_000 + "deep" + "</span>" * 30_000) == "deep"
    assert main_text("<li>" * 20_000 + "z") == "z"
    assert main_text("<p title='a>b'>quoted</p><p title=\"x>unclosed</p>") .startswith("quoted")
    assert main_text("<body><article><p>" + "long " * 200_000 + "</article>") == ("long " * 200_000).strip()
    rows = [(1, "u", None, 1, "x"), (1, "u", None, 1, "x"), (2, None, "", 2, "y"), (None, "v", "<article><p>T x</article>", 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    made = sorted((tuple(r) for r in extract(pages).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    assert made == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", "T x", 3)], key=repr)
    assert extract(pages.limit(0)).count() == 0 and len(edges.ROWS)


def test_attributes_are_read_by_their_whole_names():
    for attrs in ('aria-hidden="false"', 'title="hidden gems of Rome"', 'data-role="search"', "data-id=nav", "title='a class=ad b'", 'data-x="1"\nalt="id=menu"'):
        assert main_text(f"<body><article><p>{LONG}</p><section {attrs}><p>kept</p></section></article>").endswith("kept"), attrs
    for attrs in ("hidden", 'HIDDEN=""', 'title="x" hidden', "role = 'search'", "data-x=1 class=ad", 'x="1"class="ad"'):
        assert main_text(f"<body><article><p>{LONG}</p><section {attrs}><p>gone</p></section></article>") == LONG.strip(), attrs


def test_names_do_not_take_the_article_along():
    whole = " ".join((LONG * 4).split())
    for name in ("content no-sidebar", "has-sidebar", "with-comments", "cookie-consent-shown", "sidebar", "page-header", "navigation"):
        for page in (f"<article><p>{LONG * 2}</p><p>{LONG * 2}</p></article>", f"<div><p>{LONG * 2}</p><p>{LONG * 2}</p></div>"):
            assert main_text(f"<body><div class='{name}'>{page}</div></body>") == whole, name
    for block in ("<h2 id='search'>{}</h2>", "<section id='related-work'><p>{}</p></section>", "<p class='social-history'>{}</p>", "<section id='search'><p>{}</p></section>"):
        assert main_text(f"<body><article><p>{LONG}</p>{block.format('Kept text')}</article></body>") == f"{LONG}Kept text", block
    links = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>"
    for block in ("<div class='related-posts'>{}</div>", "<div id=sidebar>{}</div>", "<div class='x ad-slot'>Buy</div>", "<div class='share'>{}</div>", "<div id='comments'><article><p>" + LONG * 9 + "</article></div>"):
        assert main_text(f"<body><main><p>{LONG}</p>{block.format(links)}</main></body>") == LONG.strip(), block


def test_several_parts_under_the_body():
    part = lambda x, n: f"<p>{x} {LONG}</p>" * n
    want = lambda *xs: " ".join(f"{x} {LONG.strip()}" for x, n in xs for _ in range(n))
    links = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>"
    for name in ("section", "div"):
        page = f"<body><h1>Title</h1><{name}>{part('a', 10)}</{name}>{links}<{name}>{part('b', 10)}</{name}<{name}><p>Short.</p></{name}></body>"
        assert main_text(page.replace(f"</{name}<{name}>", f"</{name}><{name}>")) == f"Title {want(('a', 10), ('b', 10))} Short."
    inner = f"<article>{part('a', 10)}</article><div><p>We use cookies</p></div><article><p>b</p></article>"
    assert main_text(f"<body>{inner}</body>") == f"{want(('a', 10))} b"
    assert main_text(f"<body><div><div>{inner}</div></div></body>").endswith(" b")
    for page in ("<body>{}</body>", "{}"):
        assert main_text(page.format(f"Loose <b>te</b>xt<section>{part('a', 10)}</section>{links}<section>{part('b', 5)}</section>")) == f"Loose text {want(('a', 10), ('b', 5))}"
    assert main_text(f"<body><div><h1>T</h1>{part('a', 3)}</div><div><div>{part('b', 9)}</div>{links * 9}</div></body>") == f"T {want(('a', 3), ('b', 9))}"
    assert main_text(f"<body><main><h1>T</h1>{part('a', 3)}</main><div>{LONG}</div></body>") == f"T {want(('a', 3))}"


def test_a_slash_ends_no_page_element():
    body = "<p>Main words come here and go on.</p>"
    for apart in (
        "<script src=/js/app/>var leak=1;</script>",
        "<script src='/js/app'/>var leak=1;</script>",
        "<style/>p{leak:1}</style>",
        "<div class='ad'/>Buy now leak</div>",
    ):
        assert main_text(f"<body><article>{apart}{body}</article></body>") == "Main words come here and go on.", apart
    # a link with a slash at its end holds its text, so that a list of them is mostly links
    links = "".join(f"<a href=/docs/{i}/>leaking entry {i}</a> " for i in range(8))
    page = f"<body><article><div class='related'>{links}</div>{body}</article></body>"
    assert main_text(page) == "Main words come here and go on."


def test_drawings_and_formulas_keep_their_text():
    formula = "<math><semantics><mrow><mi>x</mi><mspace/><mo>=</mo><mn>2</mn></mrow><annotation>x=2 tex</annotation></semantics></math>"
    assert main_text(f"<article><p>So {formula} holds.</p></article>") == "So x=2 holds."
    chart = "<svg viewBox='0 0 1 1'><title>icon</title><defs><text>unused</text></defs><path d='M0'/><text x='1'>Peak <tspan>1990</tspan></text></svg>"
    assert main_text(f"<article><p>See {chart} here.</p></article>") == "See Peak 1990 here."
    assert main_text("<article><p>One <svg/>two <svg><path/>three</p><p>Four</p></article>") == "One two three Four"
    assert main_text("<article><svg><foreignObject><div>Inner</div><p>words</p></foreignObject><style>x{}</style></svg></article>") == "Inner words"


def test_names_of_adverts_and_comments_inside_the_article():
    long = "<p>A paragraph of the article with quite a few words in it, so that it reads like one.</p>"
    kept = " ".join(["A paragraph of the article with quite a few words in it, so that it reads like one."] * 3)
    for name in (
        "ad-unit", "adsbygoogle", "google-ads", "promo-box", "social-share", "user-comments", "replies", "taboola-ad", "adUnit", "fb-comments",
        "userComments", "dfp-ad", "cookie-consent",
    ):
        page = f"<body><article>{long * 2}<div class='{name}'>Buy <b>now</b></div>{long}</article></body>"
        assert main_text(page) == kept, name
    for name in ("ad-hoc", "header-image", "widgets", "with-comments", "no-ads", "tag-ads", "has-sidebar", "comments-closed", "trade-history"):
        page = f"<body><article>{long}<div class='{name}'>{long}</div>{long}</article></body>"
        assert main_text(page) == kept, name


def test_comments_in_code_are_text():
    page = "<article><p>Try this.</p><pre><code><span class='token comment'># first</span> run()</code></pre></article>"
    assert main_text(page) == "Try this. # first run()"
