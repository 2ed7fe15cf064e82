import time

import pytest

from faultline.llm import html as H

BODY = ["A first paragraph with some words, long enough to count as prose. It has two sentences.",
        "Short one.", "Another paragraph, with commas, stops; and more than a few words in it, so that it weighs.",
        "The last words of the article come here, before everything else on the page ends."]
PARTS = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and much more</a></li></ul></nav>",
    "menu": "<div class='main-menu'><a href=1>One</a> <a href=2>Two</a></div>",
    "header": "<header><h2>Site name, a slogan. And more.</h2></header>",
    "sidebar": "<div id='sidebar'><p>Popular posts, all of them. Read now, please, it is great fun for everyone!</p></div>",
    "aside": "<aside>Something aside, not part of it.</aside>",
    "notice": "<div class='cookie-notice'>We use cookies, as all do. Accept them, please.</div>",
    "ad": "<div class='ad'>Buy this, now. It is cheap, good, and yours.</div>",
    "form": "<form><label>Name, please</label><input><textarea>x</textarea><button>Send it</button></form>",
    "script": "<script>var a = '<p>not, text.</p>';</script><style>p > a {x: y}</style><noscript>Please enable, it.</noscript>",
    "comments": "<section class='comments'><p>Great article, thanks. I liked it, a lot, really, and so did my friends.</p></section>",
    "footer": "<footer>&copy; 2020 somebody, all rights reserved. Terms, privacy.</footer>",
    "comment": "<!-- <p>hidden, text.</p> -->",
}


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><div class='post'>{}</div></main>", "<div class='content'>{}</div>", "<div>{}</div>", "{}"])
@pytest.mark.parametrize("parts", [[], ["nav", "ad", "footer"], list(PARTS)])
def test_article_without_surroundings(shell, parts):
    paragraphs = "".join(f"<p>{x}</p>" for x in BODY)
    before = "".join(PARTS[p] for p in parts if p not in ("footer", "comments"))
    after = "".join(PARTS[p] for p in parts if p in ("footer", "comments"))
    page = f"<!DOCTYPE html><html><head><title>T, t.</title></head><body>{before}{shell.format(paragraphs)}{after}</body></html>"
    assert H.main_text(page) == "\n".join(BODY)


def test_blocks_references_and_broken_markup():
    page = ("<article><h1>Title &amp; more</h1><p><b>First  line,\n with <i>markup</i>.<br><p>Second &lt;one&gt;&nbsp;here, it's &#233;&#xe9;.</p>"
            "<ul><li>Item one, <li>Item two.</ul><p>a<span>b</span>c</p></div></article>")
    assert H.main_text(page) == "Title & more\nFirst line, with markup.\nSecond <one> here, it's éé.\nItem one,\nItem two.\nabc"


def test_unmarked_link_list_beside_prose():
    links = "<div>" + "".join(f"<a href=/{i}>Section {i}</a> " for i in range(30)) + "</div>"
    page = f"<body>{links}<div>{''.join(f'<p>{x}</p>' for x in BODY)}</div></body>"
    assert H.main_text(page) == "\n".join(BODY)


def test_null_empty_and_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "plain, text"), (4, "u", "<p"), (None, "u", "<article><p>x.</article>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, main_text int")
    got = sorted([(r.page_id, r.url, r.text, r.n_chars) for r in H.extract(df).collect()], key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (3, "u", "plain, text", 11), (4, "u", "", 0), (None, "u", "x.", 2)], key=str)
    assert H.extract(df.limit(0)).collect() == []


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    assert H.main_text("<article>" + "<p>word, word.</p>" * 50000 + "</article>").count("\n") == 49999
    assert H.main_text("<div>" * 50000 + "x." + "</i>" * 50000) == "x."
    assert H.main_text("<b>" * 30000 + "<p>x." * 1000).count("x.") == 1000
    assert time.time() - began < 60


LONG = "".join(f"<p>{x}</p>" for x in BODY)


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "class='content no-sidebar'", "id='search-results-article'",
                                     "class='search'", "id='page-banner'"])
def test_names_do_not_veto_the_wrapper_of_the_page(wrapper):
    parts = PARTS["nav"] + PARTS["ad"] + PARTS["sidebar"]
    assert H.main_text(f"<body><div {wrapper}>{parts}<div>{LONG}</div></div>{PARTS['footer']}</body>") == "\n".join(BODY)


def test_form_around_the_whole_page():
    assert H.main_text(f"<body><form id='f'>{PARTS['menu']}<div>{LONG}</div></form></body>") == "\n".join(BODY)


def test_nothing_lost_beside_the_longest_element():
    page = f"<body>{PARTS['nav']}<h1>Title</h1><div class=lead><p>A lead, in short.</p></div><div class=content>{LONG * 5}</div></body>"
    assert H.main_text(page) == "\n".join(["Title", "A lead, in short.", *BODY * 5])
    three = f"<body><div><p>One, first.</p></div><div>{LONG * 3}</div><div><p>Three, last.</p></div></body>"
    assert H.main_text(three) == "\n".join(["One, first.", *BODY * 3, "Three, last."])


def test_misleading_names_inside_the_article():
    page = f"<article><p class='share-price'>The price fell.</p>{LONG}<p class='social-history'>A history, in short.</p>{PARTS['ad']}</article>"
    assert H.main_text(page) == "\n".join(["The price fell.", *BODY, "A history, in short."])


def test_reader_comments_never_count_however_long():
    page = f"<body><div class=post>{LONG}</div><div id='comments-list'>{LONG * 4}</div></body>"
    assert H.main_text(page) == "\n".join(BODY)
    page = f"<article>{LONG}</article><article class='comment'>{LONG * 4}</article>"
    assert H.main_text(page) == "\n".join(BODY)


def test_the_ratios_decide(monkeypatch):
    links = "<div>" + "".join(f"<a href=/{i}>Section {i}</a> " for i in range(30)) + "</div>"
    page = f"<body>{links}<div class=x>Log in</div><div class=y>{LONG}</div></body>"
    assert H.main_text(page) == "\n".join(BODY)
    monkeypatch.setattr(H, "content_nodes", lambda texts: [True] * len(texts))
    assert H.main_text(page) != "\n".join(BODY)
