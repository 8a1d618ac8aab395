import html
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
from helpers import with_clashes
from multisvm.llm import html_text
from multisvm.llm.html_text import content_lines, extract_text, main_text, smoothed


def test_articles_of_the_pages_table():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        inside = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert main_text(page) == "\n\n".join(b for b in blocks if b)


LONG = "A sentence of the article that is long enough to be told from a menu, with some words."


def test_furniture_goes_and_short_blocks_stay():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
    <div id="content"><div class="ad-slot">{LONG}</div><h1>Head &amp; line</h1><p>{LONG}<p>Short.</p>
    <div class="cookie notice"><p>{LONG}</p></div><blockquote>{LONG} <a href=z>with a link</a> &lt;here&gt;</blockquote>
    <form><p>{LONG}</p><input name=q><button>Go</button></form><script>var a = "<p>{LONG}</p>";</script></div>
    <aside>{LONG}</aside><section id="comments"><p>{LONG}</p><article class="comment">{LONG}</article></section>
    <footer><p>{LONG}</p></footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Head & line", LONG, "Short.", f"{LONG} with a link <here>"]


def test_article_among_heavier_text():
    page = f"<body><div>{LONG * 4}</div><main><article><header><h2>T</h2></header><p>One\n  two<br>three</p></article></main><div>{LONG * 3}</div></body>"
    assert main_text(page) == "T\n\nOne two three"


def test_parts_of_an_article():
    page = f"""<article class="post"><div class="post-header"><h1>Head</h1><p class="byline">By a person</p></div><p>{LONG}</p>
    <div class="related-posts"><h2>Related</h2><ul><li>{LONG}</li></ul></div><figure><img src=x><figcaption>Caption</figcaption></figure>
    <table><tr><td>a</td><td>b</td></tr></table><div class="commentList"><h2>Comments</h2><p>{LONG}</p></div></article>"""
    assert main_text(page).split("\n\n") == ["Head", "By a person", LONG, "Caption", "a", "b"]


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<nav>menu</nav>") == ""
    assert main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert main_text("<div><p>one<p>two</div></p></section>three").split("\n\n")[:2] == ["one", "two"]
    assert main_text("<p>" + "&amp; word " * 50_000) == ("& word " * 50_000).strip()  # across many chunks
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_ratios_cluster():
    ratios = np.array([1.0, 2, 1, 80, 90, 3, 85, 1, 2])
    content = content_lines(smoothed(ratios))
    assert content[3:7].all() and not content[0] and not content[-1]
    assert content_lines(np.array([5.0, 5.0])).all()


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (2, None, None), (None, "v", "")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = extract_text(df)
    assert out.columns == [*df.columns, "text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "", LONG]
    assert extract_text(df.limit(0)).count() == 0


def test_no_tag_and_no_share_decides_what_is_dropped():
    text = [f"{LONG} Paragraph {i}." for i in range(10)]
    body = "".join(f"<p>{t}</p>" for t in text)
    card = "<article><h3>Card</h3><p>Read on.</p></article>"
    # the text of a page beside a small article
    assert main_text(f"<body><div>{body}</div>{card}</body>").split("\n\n") == [*text, "Card", "Read on."]
    # articles of every size, but no cards in a container named as furniture
    small = "<article><p>Small one.</p></article>"
    assert main_text(f"<article>{body}</article>{small}<main>{small}</main>").split("\n\n") == [*text, "Small one.", "Small one."]
    assert main_text(f"<article>{body}</article>{small}<div class=related>{card}</div>").split("\n\n") == [*text, "Small one."]


def test_title_lead_and_smaller_sections_stay():
    text = [f"{LONG} Paragraph {i}." for i in range(10)]
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<body><div><a href=x>One</a></div><div id=page><h1>T</h1><div class=lead><p>intro</p></div><div class=entry>{body}</div></div></body>"
    assert main_text(page).split("\n\n") == ["T", "intro", *text]
    part = f"<p>{LONG}</p>" * 4
    nested = f"<div>{body * 2}</div>"
    for _ in range(3):  # under a fifth of its level each
        nested = f"<div>{nested}</div><section>{part}</section>"
    assert main_text(f"<body>{nested}</body>").split("\n\n") == [*text, *text, *[LONG] * 12]
    assert main_text(f"<div><p>{LONG * 3}</p><p>Short.</p></div>").split("\n\n") == [LONG * 3, "Short."]


def test_declarations_and_unfinished_markup():
    assert main_text("<p>a</p><![foo bar]><p>b</p>") == "a\n\nb"
    assert main_text("<p>a</p><![ x]><p>b</p>") == "a\n\nb"
    assert main_text("<p>a</p><![if IE]><p>b</p><![endif]--><p>c</p>") == "a\n\nb\n\nc"
    assert main_text("<p>a</p><![CDATA[ x > y ]]><p>b</p><!weird><?php x ?><p>c</p>") == "a\n\nb\n\nc"
    assert main_text("<p>a</p><!-- no end <p>b</p>") == "a"
    assert main_text('<p>a</p><a href="x') == main_text("<p>a</p><p class") == main_text("<p>a</p></p") == main_text("<p>a</p><![x") == "a"
    assert main_text("<p>a &lt b & c &amp</p>") == "a < b & c &"


def test_any_mix_of_markup_gives_text():
    rng = random.Random(11)
    parts = ["<p>", "</p>", "<div class=nav>", "</div>", "<a href='x'>", "</a>", "<!", "<![", "<!--", "-->", "]]>", "<![CDATA[", "<?", "?>", "<script>",
             "</script>", "<", ">", "&", "&#", "&#x110000;", "&#0;", "&bogus;", "\"", "'", "<a b='", "</", "</ x", "<article>", "</article>", "<!DOCTYPE",
             "[", "text", "long text of a page, with words", "\x00", "퟿", "é", "<br/", "<li", "=", "/>", "<title>", "<textarea>", "<svg><p>", "<p/>"]
    for _ in range(1500):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert isinstance(main_text(page), str)


def test_words_inside_a_name_are_not_furniture():
    blocks = ['<section id="related-work"><p>{}</p></section>', '<section id="search-algorithms"><p>{}</p></section>',
              '<div id="form-of-government"><p>{}</p></div>', '<p id="copyright-law">{}</p>', '<p>The <span class="share-price">{}</span></p>']
    for i, block in enumerate(blocks):
        for around in ("<article>{}</article>", '<div class="story">{}</div>'):
            page = around.format(f"<h1>T</h1><p>{LONG}</p>{block.format(f'Kept {i}.')}<p>{LONG}</p>")
            assert f"Kept {i}." in main_text(page)
    for name in ("related-posts", "ad-slot", "cookie notice", "commentList", "social-share-buttons", "newsletterSignup", "site-footer"):
        assert "Gone" not in main_text(f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>Gone.</p></div></article>"), name
    assert main_text(f"<div class='page-header'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>") == f"T\n\n{LONG}\n\n{LONG}"  # the story itself


LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(6)) + "</ul>"


def test_lists_of_links_beside_and_around_the_story_go():
    story = f"<h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = ["T", LONG, "Short.", LONG]
    assert main_text(f"<body>{LINKS}<div>{story}</div></body>").split("\n\n") == want
    assert main_text(f"<body><div>{LINKS}{story}{LINKS}</div></body>").split("\n\n") == want
    assert main_text(f"<body><main>{LINKS}{story}</main></body>").split("\n\n") == want
    # links with words of their own, and two links, stay
    cited = "<ul>" + "".join(f"<li><a href=/{i}>Paper {i}</a>, by some people, in a journal</li>" for i in range(3)) + "</ul>"
    assert main_text(f"<body><div>{story}{cited}<p><a href=x>One</a></p><p><a href=y>Two</a></p></div></body>").count("Paper") == 3
    assert main_text(f"<body><div>{story}<p><a href=x>One</a></p><p><a href=y>Two</a></p></div></body>").endswith("One\n\nTwo")


def test_the_ratios_decide(monkeypatch):
    story = ["T", "Short.", LONG, LONG, "Short.", "Short."]
    outside = "".join(f"<p>Tiny {i}.</p>" for i in range(5))
    page = f"<body><div>{outside}</div><div><h1>T</h1>{''.join(f'<p>{x}</p>' for x in story[1:])}</div><div>{outside}</div></body>"
    with_ratios = main_text(page)
    monkeypatch.setattr(html_text, "content_lines", lambda ratios: np.ones(len(ratios), bool))
    assert with_ratios.split("\n\n") == story and main_text(page).count("Tiny") == 10


def test_stray_end_tags_cost_linear_time():
    def took(n):
        page = "<div>" * n + "text" + "</section></p></li>" * n
        start = time.perf_counter()
        assert main_text(page) == "text"
        return time.perf_counter() - start

    took(500)
    assert took(8000) < 40 * took(1000)
