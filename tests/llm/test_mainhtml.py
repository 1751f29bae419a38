import math
from collections import Counter

import pytest

from kvspark.llm import mainhtml

SF = "/root/testdata/sf0.01"


def test_query_prints_the_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = {" ".join(r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()}
    docs |= {" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    rows = mainhtml.query(pages).collect()
    assert len(rows) == pages.count()
    assert all(r.n_chars == len(r.text) for r in rows)
    bodies = [" ".join(" ".join(r.text.split("\n")[1:]).split()) for r in rows]
    assert sum(b in docs for b in bodies) == len(rows)


def test_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article class=post><header><h1>A &amp; B</h1></header>
    <p>One<b> two</b>&nbsp;three<br>four<p>five <!-- no --> six<script>var p = "</p>";</script>
    <ul><li>x<li>y</ul><aside>side</aside><div class="ad">buy</div><form>f<input></form>
    <section id="comments"><p>reader says</p></section></article></main><footer>&copy;</footer></body></html>"""
    assert mainhtml.main_text(page, set()) == "A & B\nOne two three four\nfive six\nx\ny"
    assert mainhtml.main_text("", set()) == ""
    wrapped = "<body class='single no-comments'><form id=f><div>log in</div><article class='post comments-open'><p>in</p><form>f</form></article></form><article class=comment>r</article>"
    assert mainhtml.main_text(wrapped, set()) == "in"
    # Letters whose lower case is longer, and names that only begin like the end of a script.
    assert mainhtml.main_text("<p>\u0130\u0130\u0130\u0130</p><SCRIPT>a</scripts>b</Script ><p>after</p>", set()) == "\u0130\u0130\u0130\u0130\nafter"
    assert mainhtml.main_text("plain <b>text", set()) == "plain text"
    assert mainhtml.main_text("a < b <p class='x\" >c", set()).startswith("a < b")


def test_style_tree_removes_what_returns(spark):
    rows = []
    for i in range(12):
        body = "".join(f"<p>Body {i} part {k} words</p>" for k in range(3))
        rows.append((i, f"http://h.example/{i}", f"<body><div class=top><p>Same slogan</p></div><div class=text>{body}</div></body>", 5))
    rows += [(90, "http://other.example/", "<div class=top><p>Same slogan</p></div>", 5), (91, None, None, 5), (92, "::bad[", "", 5), (0, rows[0][1], rows[0][2], 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = mainhtml.query(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[3] == "Body 3 part 0 words\nBody 3 part 1 words\nBody 3 part 2 words"
    assert text[90] == "Same slogan" and text[91] == text[92] == ""
    assert mainhtml.query(pages.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "http://h.example/", "<article>" + "<p>word &lt;</p>" * 20000 + "</article>")], "page_id long, url string, html string")
    assert mainhtml.query(long).head().n_chars == 20000 * 7 - 1


def test_raw_elements():
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>y<svg><text>label</text></svg></p><object><p>instead</p></object></article>"
    assert mainhtml.main_text(page, set()) == "so x=2 holds\ny\nlabel\ninstead"
    nested = "<p>a</p><template><template>in</template>out</template><select><option>o</select><p>b</p>"
    assert mainhtml.main_text(nested, set()) == "a\nb"
    for tag in ("svg", "iframe", "math", "textarea", "select", "template"):
        assert mainhtml.main_text(f"<p>a</p><{tag}><p>rest of the page</p>", set()) == "a\nrest of the page"


def test_names_do_not_drop_main_text():
    for name in ("content-sidebar-wrap", "layout has-sidebar", "sidebar", "related"):
        for zone in ("main", "article"):
            page = f"<body><nav>menu</nav><div class='{name}'><{zone}><p>The story.</p></{zone}></div><div class=sidebar>more</div>"
            assert mainhtml.main_text(page, set()) == "The story."
    paragraphs = "".join(f"<div class='elementor-widget-container'><p>Part {i}.</p></div>" for i in range(3))
    assert mainhtml.main_text(f"<article>{paragraphs}</article>", set()) == "Part 0.\nPart 1.\nPart 2."
    paragraphs = paragraphs.replace("elementor-widget-container", "widget")
    assert mainhtml.main_text(f"<article>{paragraphs}<div class=ad>buy</div></article>", set()) == "Part 0.\nPart 1.\nPart 2."
    for name in ("related-work", "share-price", "skip", "register"):
        page = f"<article><p>A long enough first part.</p><section id={name}><p>Words.</p></section></article>"
        assert mainhtml.main_text(page, set()).endswith("\nWords.")
    comments = "<article><p>In.</p></article><div class=comments><article class=comment-body><p>A reader.</p></article></div>"
    assert mainhtml.main_text(comments.replace("In.", "The story itself."), set()) == "The story itself."


def test_tree_decides_in_articles_too(spark):
    rows = []
    for i in range(12):
        body = "".join(f"<p>Story {i} part {k} of it</p>" for k in range(3))
        rows.append((i, f"http://h.example/{i}", f"<article>{body}<div class=plea><p>Give to us</p></div></article>"))
        cards = "".join(f"<article class=card><p>Card {k}</p></article>" for k in range(2))
        rows.append((100 + i, f"http://t.example/{i}", f"<div class=text>{body}</div>{cards}"))
        rows.append((200 + i, "http://copies.example/", "<article><p>One and the same text</p></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in mainhtml.query(pages).collect()}
    assert text[3] == "\n".join(f"Story 3 part {k} of it" for k in range(3))
    assert text[103].startswith(text[3])
    assert text[203] == "One and the same text"


def test_short_article_beside_a_long_advert():
    page = "<div class=ad>Buy this, and that, and much more.</div><article><h1>Few</h1><p>words.</p></article>"
    assert mainhtml.main_text(page, set()) == "Few\nwords."


def test_parts_of_an_article_survive():
    page = "<article><p>Energy <math><mi>e</mi></math> is</p><div class='stock alert'>Stocks fall.</div><object><p>A chart.</p></object><div class='share-price'>9 pounds</div><p class='related'>Related work.</p></article>"
    assert mainhtml.main_text(page, set()) == "Energy e is\nStocks fall.\nA chart.\n9 pounds\nRelated work."


def site(spark):
    rows = []
    for i in range(9):
        body = "".join(f"<p class=p{k}>Story {i} part {k} of it</p>" for k in range(4))
        plea = "<div class=plea><p>Give to us</p><ul><li>now<li>or later</ul></div>" if i % 3 else ""
        rows.append((i, f"http://h.example/{i}", f"<article>{body}{plea}<div class='related-box'><p>More {i % 2}</p></div></article>"))
        rows.append((50 + i, "http://t.example/x", f"<div class=top>Slogan</div><div class=text>{body * (i % 2 + 1)}</div><p>{i}</p>"))
    return spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")


def plain_low(pages, threshold=0.4, damping=0.9):
    """The low nodes of each host, from the definitions: counts page by page, then entropies."""
    seen = {}
    for url, page in pages:
        blocks, nodes = mainhtml.parse(page)
        told = {}
        for x in nodes:
            if x.mark in (mainhtml.PLAIN, mainhtml.MAIN):
                node = told.setdefault(x.key, {"said": 0, "shown": Counter(), "texts": Counter()})
                node["said"] = max(node["said"], mainhtml.VAGUE if x.vague else x.mark)
                if x.children:
                    node["shown"][tuple(x.children)] += 1
        for x, t in blocks:
            if x.mark in (mainhtml.PLAIN, mainhtml.MAIN):
                told.setdefault(x.key, {"said": None, "shown": Counter(), "texts": Counter()})["texts"][t] += 1
        for key, node in told.items():
            seen.setdefault((mainhtml.host(url.encode()), key), []).append(node)
    low = {}
    for (host, key), here in seen.items():
        texts = {t for n in here for t in n["texts"]}
        here_said = [n for n in here if n["said"] is not None]
        m = len(here_said)
        if not texts:
            continue

        def entropy(counts):
            total = sum(counts)
            return -sum(c / total * math.log(c / total) for c in counts if c)

        share = lambda e: min(1.0, e / math.log(m)) if m > 1 else None
        said = max((n["said"] for n in here_said), default=None)
        shown = sum((n["shown"] for n in here), Counter())
        if said == mainhtml.VAGUE:
            presentation = 0.0
        elif said == mainhtml.MAIN:
            presentation = 1.0
        elif m == 1:
            presentation = 1.0
        else:
            presentation = share(entropy(shown.values())) if shown and m > 1 else 0.0
        mean = sum(entropy([n["texts"][t] for n in here]) for t in texts) / len(texts)
        content = 1 - share(mean) if m > 1 else 1.0
        own = damping ** min(len(texts), 50)
        if own * content + (1 - own) * max(presentation, content) < threshold - 1e-12:
            low.setdefault(host, set()).add(key)
    return low


@pytest.mark.parametrize("table", ["site", SF])
def test_query_equals_a_plain_style_tree(spark, table):
    pages = site(spark) if table == "site" else spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", "url", "html").collect()
    low = plain_low([(r.url, r.html or "") for r in rows])
    want = sorted((r.page_id, mainhtml.main_text(r.html or "", low.get(mainhtml.host(r.url.encode()), set()))) for r in rows)
    assert sorted((r.page_id, r.text) for r in mainhtml.query(pages).collect()) == want
    assert sorted((r.page_id, r.text) for r in mainhtml.extract(pages, broadcast_mb=0).collect()) == want


def test_importance_decides(spark):
    pages = site(spark)
    own = {r.page_id: r.text for r in mainhtml.query(pages).collect()}
    without = {r.page_id: r.text for r in mainhtml.extract(pages, threshold=0.0).collect()}
    assert "Give to us" not in own[1] and "Give to us" in without[1]
    assert all(own[i].startswith(f"Story {i} part 0") for i in range(9))
    assert "Slogan" not in own[51] and "Slogan" in without[51]
