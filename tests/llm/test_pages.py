"""Main text of pages."""

import pytest

from speccurve.llm import html_text

ARTICLE = (
    "<html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body>"
    "<header>Site</header><nav><ul><li><a href='/'>Home</a><li>About</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div id=sidebar>Side <p>bar</div>"
    "<article class=post><h1>Head &amp; line</h1><p>One&nbsp;two\n three <b>bold</b>er"
    "<p>Next<br>line<form><input><label>Mail</label></form>"
    "<section class='comments'><p>First!</p></section><p>Last &#233; &lt;x&gt; 1 < 2</article>"
    "<aside>More</aside><footer>&copy; 2024</footer><!-- <p>no</p> --></body></html>"
)


def page(own: str) -> str:
    return (
        "<body><div>Welcome to the site of all things</div>"
        f"<div><p>{own}</p></div><div>All rights reserved by us for ever</div></body>"
    )


@pytest.fixture(scope="module")
def rows(spark):
    pages = [
        (0, "http://a.example/x", ARTICLE), (1, "http://a.example/y", None), (2, None, ""),
        (3, "http://a.example/z", "plain text &amp; no\n markup"),
        *[(10 + i, f"https://u@B.example:80/{i}", page(" ".join(f"own{i}x{k}" for k in range(7))))
          for i in range(5)],
        (20, "http://c.example/", page("the same words on both pages")),
        (21, "http://c.example/2", page("the same words on both pages")),
        (30, "x", "<main><p>In main</p></main><p>outside</p>"),
        (31, "x", "<div class='entry-content'><p>In entry</p></div><p>outside</p>"),
        (32, "x", "<p>unclosed <div class=ad>ad</div> tail" + "<b>" * 2000),
        (None, "x", "<article>" + "word " * 50_000 + "</article>"),
    ]
    pages.append(pages[0])
    table = spark.createDataFrame(
        [(*p, "mine", 5) for p in pages],
        "page_id long, url string, html string, text string, n_chars int",
    ).repartition(3)
    return html_text.main_text(table).collect()


def test_pages(rows):
    assert len(rows) == 16
    text = {r["page_id"]: r["text"] for r in rows}
    assert text[0] == "Head & line\n\nOne two three bolder\n\nNext line\n\nLast é <x> 1 < 2"
    assert text[1] == text[2] == ""
    assert text[3] == "plain text & no markup"
    for i in range(5):
        assert text[10 + i] == " ".join(f"own{i}x{k}" for k in range(7))
    # Two copies of one page say nothing about what is boilerplate.
    assert text[20] == text[21] and "Welcome" in text[20]
    assert text[30] == "In main" and text[31] == "In entry"
    assert text[32] == "unclosed\n\ntail"
    assert text[None] == " ".join(["word"] * 50_000)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["page_id"]: r["n_boilerplate"] for r in rows}[10] == 2


LONG = "<p>" + " ".join(f"long{i}" for i in range(40)) + "</p>"
BODY = " ".join(f"long{i}" for i in range(40))


@pytest.mark.parametrize("source, want", [
    (f"<main class='with-sidebar'>{LONG}</main><div class='sidebar'>side</div>", BODY),
    (f"<article class='post has-comments'>{LONG}<div id=comments>no</div></article>", BODY),
    (f"<body><form id=aspnet><div class=nav-menu>menu</div><article>{LONG}</article></form>", BODY),
    (f"<form>{LONG}<div class=siteFooter>foot</div></form>", BODY),
    (f"<div id='page' class='login-wrapper'><article>{LONG}</article></div><p>x</p>", BODY),
    (f"<article><p>teaser</p></article><div class=content>{LONG}</div>", f"teaser\n\n{BODY}"),
    (f"<article>{LONG}<div class='related-work'>Work</div></article>", f"{BODY}\n\nWork"),
    (f"<article>{LONG}<div class='related-posts'>no</div><form>no</form></article>", BODY),
    (f"<article><div class='comments'><article><p>no</p></article></div>{LONG}</article>", BODY),
    (f"<div class='cookie-banner'>no {LONG[3:90]}</div>{LONG}", BODY),
    (f"<footer>{LONG}</footer><div class=ads><p>ad</p></div>", ""),
])
def test_classes_do_not_void_the_article(source, want):
    found = html_text.blocks(source)
    best = html_text.article_level(found)
    assert "\n\n".join(text for level, text in found if level >= best) == want


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(none).count() == 0


def test_articles_of_the_table(spark, sf_dir):
    import html
    import re

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()}
    for row in table.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.DOTALL)[1]
        parts = re.split(r"</?p>|</?h1>", inner.replace("<br>", " "))
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert found[row["page_id"]] == "\n\n".join(filter(None, parts))


def in_article(blocks, furniture="<nav>a b c d e f g</nav>"):
    return f"{furniture}<article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>"


def cut_by_brute_force(articles):
    """Of one host's articles (lists of blocks): every run of LONG tokens, and every
    block, held by PAGES distinct articles goes, unless that is most of an article."""
    long, out = html_text.LONG, []
    tokens = [[t for b in blocks for t in ("\n", *b.split(" "))] for blocks in articles]
    runs = [{tuple(t[i : i + long]) for i in range(len(t) - long + 1)} for t in tokens]
    for k, blocks in enumerate(articles):
        t, gone, lost, kept = tokens[k], set(), 0, []
        for i in range(len(t) - long + 1):
            if sum(tuple(t[i : i + long]) in x for x in runs) >= html_text.PAGES:
                gone |= set(range(i, i + long))
        at = 0
        for block in blocks:
            n = len(block.split(" "))
            if n >= html_text.RUN and sum(block in x for x in articles) >= html_text.PAGES:
                gone |= set(range(at, at + n + 1))
            at += n + 1
        gone -= {i for i, x in enumerate(t) if x == "\n"}
        if 2 * len(gone) >= len(t) - len(blocks):
            gone = set()
        at = 0
        for block in blocks:
            n = len(block.split(" "))
            left = [t[i] for i in range(at + 1, at + n + 1) if i not in gone]
            at, lost = at + n + 1, lost + (len(left) < n)
            if left:
                kept.append(" ".join(left))
        out.append(("\n\n".join(kept), lost))
    return out


def test_repeats_inside_articles(spark):
    """What many pages of a host have inside their articles goes from them."""
    from random import Random

    draw = Random(4)

    def words(n):
        return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))

    offer, notice, edge = words(11), words(45), words(html_text.LONG)
    almost, rare = words(html_text.LONG - 1), words(40)
    articles = []
    for i in range(8):
        blocks = [words(60), f"{words(20)} {notice} {words(15)}", words(50), words(4)]
        blocks[2] += f" {edge if i < 3 else almost} {words(3)}"
        if i % 2:
            blocks.insert(draw.randrange(4), offer)
        if i < 2:
            blocks.append(f"{words(9)} {rare}")
        articles.append(blocks)
    # Across the border of two blocks, and near copies of one page.
    across = words(50).split(" ")
    for blocks in articles[4:8]:
        blocks.append(f"{words(30)} {' '.join(across[:25])}")
        blocks.append(f"{' '.join(across[25:])} {words(30)}")
    copy = words(200)
    copies = [[copy, f"other{i}"] for i in range(3)]
    hosts = {"a": articles, "b": articles[:2], "c": copies, "d": [articles[0]] * 4}
    rows = [
        (100 * k + i, f"http://{host}.example/{i}", in_article(blocks))
        for k, (host, pages) in enumerate(hosts.items()) for i, blocks in enumerate(pages)
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r["page_id"]: (r["text"], r["n_boilerplate"])
             for r in html_text.main_text(table).collect()}
    want = cut_by_brute_force(articles)
    for i in range(8):
        assert found[i] == want[i], i
    assert not any(offer in text or notice in text or edge in text for text, _ in want)
    assert all(almost in text for text, _ in want[3:]) and all(rare in t for t, _ in want[:2])
    # On two pages only, on near copies, on equal pages: nothing goes.
    for k, host in enumerate("bcd", 1):
        assert [found[100 * k + i] for i in range(len(hosts[host]))] == [
            ("\n\n".join(x), 0) for x in hosts[host]
        ]
