import html as H
import random
import re
import time

import pytest

from pursebook.llm import html_text as x

ARTICLE = "<p>" + "Some text, with commas, and enough words to matter. " * 4 + "</p>"


def test_pages_of_the_test_tables(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer)", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert x.extract_text(r.html) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("noise", [
    "<nav><a href=a>Menu</a></nav>", "<header><p>Site name, slogan, more</p></header>", "<footer>&copy; 2020</footer>", "<aside><p>Side, text, long, enough</p></aside>", '<div class="sidebar"><p>a, b, c, d, e, f</p></div>',
    '<div id="cookie-notice"><p>We use cookies, lots, of, them.</p></div>', '<div class="ad-slot">Buy</div>', "<form><p>Name</p><input></form>", "<script>if(a<b){'</p>'}</script>", "<style>p{}</style>", "<!-- <p>x</p> -->",
    '<section id="comments"><p>Nice, really, really, nice.</p></section>', '<div role="navigation">x</div>', '<p hidden>x</p>', '<div style="display:none">x</div>', "<noscript><p>Enable</p></noscript>", '<div class="commentList"><p>x</p></div>',
])
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", '<div class="post">%s</div>', "%s"])
def test_boilerplate_goes_wherever_it_is(noise, shell):
    want = x.extract_text("<body>" + shell % (ARTICLE * 2) + "</body>")
    assert want.count("\n") == 1
    for page in ("<body>" + noise + shell % (ARTICLE * 2) + "</body>", "<body>" + shell % (ARTICLE * 2) + noise + "</body>", "<body>" + shell % (ARTICLE + noise + ARTICLE) + "</body>"):
        assert x.extract_text(page) == want


def test_blocks_references_and_white_space():
    page = "<article><h1>T &amp; U</h1><p>one\n\t two&nbsp;&#233;<br>three<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre> x  y </pre></article>"
    assert x.extract_text(page).split("\n") == ["T & U", "one two é three", "a", "b", "c", "d", "x y"]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a", "</p>", "<p><b>", "&", "<!--", "<script>", "<div" * 50, "<article></article>"])
def test_broken_or_empty(page):
    assert x.extract_text(page) == "" or page in ("&", "<")


def test_deep_nesting_and_link_menus():
    assert x.extract_text("<div>" * 5000 + "deep text, here" + "</div>" * 5000) == "deep text, here"
    menu = "<ul>" + "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(8)) + "</ul>"
    assert x.extract_text(f"<article>{ARTICLE}{menu}{ARTICLE}</article>").count("\n") == 1


def test_column(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "<p>hi, there</p>", "k"), (2, "<p>hi, there</p>", "k")], "page_id int, html string, text string")
    assert [r.t for r in df.select(x.main_text("html").alias("t")).collect()] == ["", "hi, there", "hi, there"]
    assert df.where("false").select(x.main_text("html")).count() == 0


@pytest.mark.parametrize("part", [
    '<p class="share-price">The price rose by ten.</p>', '<p id="hidden-gems">Some gems.</p>', '<p class="notice-of-award">An award.</p>', '<h2 class="related-work">Related work</h2>',
    '<h2 id="widgets">Widgets</h2>', '<div role="note">A note, of note.</div>', "<ul>" + "".join(f'<li><a href="http://x/{i}">Source {i}</a></li>' for i in range(4)) + "</ul>",
    "<ol>" + "".join(f'<li><a href="/{i}">Doe, J. (20{i}0). A title.</a></li>' for i in range(1, 9)) + "</ol>",
])
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "%s"])
def test_a_word_of_a_name_does_not_decide(part, shell):
    words = re.sub("<[^>]*>", " ", part).split()
    text = x.extract_text("<body><nav><a href=/>Home</a></nav>" + shell % (ARTICLE * 2 + part + ARTICLE) + "</body>")
    assert words[0] in text and text.split().count(words[-1]) >= 1 and text.count("\n") >= 3 and "Home" not in text


def test_pages_without_article_or_main():
    teaser = '<div class="teaser"><a href=/1>Other story</a> <a href=/2>More of it</a></div>'
    page = f"<body><div id=top><a href=/>Start</a></div><div class=x><h1>Title</h1><div>{ARTICLE}</div><div>{ARTICLE}</div><div>{ARTICLE}</div></div>{teaser}<div>Imprint</div></body>"
    got = x.extract_text(page).split("\n")
    assert got[0] == "Title" and len(got) == 4 and all(t.startswith("Some text") for t in got[1:])
    two = f"<body><div><p>Short.</p></div><div class=s>{ARTICLE * 3}</div><div class=s>{ARTICLE}</div><p>x</p></body>"
    assert x.extract_text(two).count("\n") == 3


def test_score_chooses_between_articles_and_against_an_empty_one():
    small = "<article><h2>Teaser</h2><p>Read on</p></article>"
    assert x.extract_text(f"<body>{small}<article><h1>T</h1>{ARTICLE * 3}</article>{small}</body>").split("\n")[0] == "T"
    assert x.extract_text(f"<body><article></article><div>{ARTICLE * 3}</div></body>").count("\n") == 2


def random_tree(rng, depth=0):
    """(tag, children or text)"""
    if depth > 4 or rng.random() < 0.35:
        words = " ".join(rng.choice(["alpha", "beta,", "gamma", "delta,"]) for _ in range(rng.randint(1, 60)))
        return ("a", words) if rng.random() < 0.2 else (rng.choice(["p", "p", "p", "h2"]), words)
    return ("div", [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))])


def as_html(t):
    tag, c = t
    inner = c if isinstance(c, str) else "".join(map(as_html, c))
    return f"<div><a href=x>{inner}</a></div>" if tag == "a" else f"<{tag}>{inner}</{tag}>"


def test_scores_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        tree = ("div", [random_tree(rng, 1) for _ in range(3)])
        want = brute_score(tree)
        nodes = x.parse(f"<body>{as_html(tree)}</body>")
        best = x.best_container(nodes, x.drop_suspects(nodes, x.blocks_of(nodes[0])))
        assert abs((best.score if best else 0.0) - want) < 1e-9


def brute_score(tree):
    """The best score by the definition: every block walks up all its containers."""
    points, chars, links = {}, {}, {}

    def walk(t, path, name):
        tag, c = t
        if not isinstance(c, str):
            for k, child in enumerate(c):
                walk(child, [*path, name], (*name, k))
            return
        around = [*path, name] if tag == "a" else path
        for up in around:
            chars[up] = chars.get(up, 0) + len(c)
            links[up] = links.get(up, 0) + (len(c) if tag == "a" else 0)
        if tag == "p":
            worth = 1 + c.count(",") + min(len(c) / 100, 3)
            for level, up in enumerate(reversed(path[-x.SCORED_ANCESTORS :]), 1):
                points[up] = points.get(up, 0) + worth / level

    walk(tree, ["#root", "body"], (0,))
    return max((p * (1 - links.get(u, 0) / chars[u]) for u, p in points.items()), default=0.0)


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "<p>a, b</p>" * 20_000, "<b>" * 20_000 + "<p>a, b</p>" * 20_000, "<div><p>a, b" * 20_000, '<p "' * 20_000, "</b>" * 20_000 + "<i>" * 20_000 + "</b>" * 20_000,
    "<ul><li>" * 20_000 + "x", "<div class=ad>" * 20_000 + "x", "<table><tr><td>" * 20_000,
])
def test_time_is_proportional_to_length(page):
    began = time.perf_counter()
    x.extract_text(page)
    assert time.perf_counter() - began < 8  # a walk to the root for each element took minutes


def test_very_long_text_is_whole(spark):
    page = "<article>" + "".join(f"<p>Paragraph {i}, whole.</p>" for i in range(100_000)) + "</article>"
    assert x.extract_text(page).count("\n") == 99_999


def test_references_split_by_markup_stay_apart():
    assert x.extract_text("<article><p>&am<b>p;</b> &lt;x, y</p></article>") == "&amp; <x, y"


LOGIN = '<form action="/login"><fieldset><legend>Log in</legend><label for=u>User, or mail</label><input id=u><p>Forgot it, again, and again?</p><button>Go</button></fieldset></form>'
SEARCH = "<form role=search><label>Search</label><input name=q><button>Find</button></form>"


@pytest.mark.parametrize("open_form,close_form", [('<form method="post" id="aspnetForm">', "</form>"), ('<div role="form">', "</div>")])
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", '<div class="post">%s</div>', "%s"])
@pytest.mark.parametrize("paragraphs", [1, 8])
def test_a_form_around_the_whole_page_keeps_the_article(open_form, close_form, shell, paragraphs):
    article = "<h1>Title</h1>" + ARTICLE * paragraphs
    want = x.extract_text("<body>" + shell % article + "</body>")
    assert want.startswith("Title\nSome text") and want.count("\n") == paragraphs
    inside = "<input type=hidden value=1><nav><a href=/>Home</a></nav>" + shell % article + "<select><option>one</option></select><label>Rate it</label><footer>Foot, note</footer>"
    assert x.extract_text(f"<body>{open_form}{inside}{close_form}</body>") == want
    # A second form beside or inside the article still goes.
    for form in (LOGIN, SEARCH):
        assert x.extract_text(f"<body>{form}{open_form}{inside}{close_form}{form}</body>") == want
        assert x.extract_text("<body>" + shell % (article + form) + form + "</body>") == want


def test_a_page_that_is_a_form_has_no_text():
    assert x.extract_text(f"<body>{LOGIN}</body>") == "" and x.extract_text(f"<body>{SEARCH}{LOGIN}</body>") == ""


def test_formulas_stay():
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding=tex>E=m\\,</annotation><annotation-xml><ci>E</ci></annotation-xml></semantics></math>"
    assert x.extract_text(f"<article>{ARTICLE}<p>Energy {formula} equals mass</p></article>").split("\n")[-1] == "Energy E=m equals mass"
