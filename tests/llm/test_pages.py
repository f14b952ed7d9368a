"""Main text: generated pages whose text is known, and odd pages."""

import html
import itertools
import re

import pytest

from understory.llm import queries as Q
from understory.llm.html_text import best_run, main_text, tokens, weights

SF = "/root/testdata/sf0.001"
BLOCK = re.compile(r"</?(?:p|h1|article|br)[^>]*>")


def test_pages_of_the_table(spark):
    """These pages mark their text by one element, so a pattern finds it."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = Q.op3_html_text(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        text = " ".join(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", "", BLOCK.sub(" ", body))).split())
        assert (r["text"], r["n_chars"]) == (text, len(text))


MAIN = "<h1>The title</h1><p>First  part &amp; more,\nin <b>bold</b>face.</p><p>Second part of a text that is long enough.</p>"
TEXT = "The title First part & more, in boldface. Second part of a text that is long enough."
BEFORE = [
    "", "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<div class='ad'>Buy now, ten words or more of advertising text here</div>",
    "<header>Site name and its motto</header>", "<div id=cookie-notice><p>We use cookies on this site, as you may know.</p></div>",
    "<script>var x = '<p>not text</p>';</script><style>p { margin: 0 }</style>", "<form>Search <input name=q> <button>Go</button></form>",
]
AFTER = [
    "", "<footer>&copy; 2024 Site, all rights reserved by the owner</footer>", "<aside>Most read today on this site</aside>",
    "<div id='comments'><p>I like this very much, thank you for it.</p></div>", "<div class='related'>More of the same</div>",
    "<!-- <p>hidden words in a comment</p> -->", "<div class='sidebar'><a href=x>Link one</a> <a href=y>Link two</a></div>",
]


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>"])
def test_furniture_is_left_out(shell):
    for before, after in itertools.product(BEFORE, AFTER):
        page = f"<html><head><title>T</title></head><body>{before}{shell % MAIN}{after}</body></html>"
        assert main_text(page) == TEXT, page


def test_furniture_inside_the_article():
    inside = MAIN.replace("</p><p>", "</p><div class='advert'>Buy this</div><form>Mail <input></form><script>x()</script><p>")
    assert main_text(f"<body><article>{inside}</article></body>") == TEXT


LEAD, REST = " ".join(f"lead{i}" for i in range(40)), " ".join(f"rest{i}" for i in range(200))
BOX = " ".join(f"box{i}" for i in range(60))


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>"])
@pytest.mark.parametrize("box", ["<form>%s <input></form>", "<div class='advert'><p>%s</p></div>", "<aside><ul><li>%s</li></ul></aside>"])
def test_long_furniture_inside_the_article(shell, box):
    for first, last in ((LEAD, REST), (REST, LEAD), (LEAD, LEAD)):
        inside = f"<p>{first}</p>{box % BOX}<p>{last}</p>"
        page = f"<body><nav>{BOX}</nav>{shell % inside}<div id='comments'><p>{BOX}</p></div></body>"
        assert main_text(page) == f"{first} {last}"


@pytest.mark.parametrize("shell", [
    "<div id='page' class='has-sidebar'><article>%s</article></div>", "<div class='content no-comments'>%s</div>",
    "<article class='post sharing'>%s</article>", "<main class='search-page'>%s</main>", "<form id='aspnetForm'>%s</form>",
    "<form id='f'><div class='page-with-menu'><nav>Home</nav><main>%s</main><div class='footer'>Imprint</div></div></form>"])
def test_wrappers_with_furniture_names(shell):
    for tail in ("", "<footer>All rights reserved</footer>"):
        assert main_text(f"<body>{shell % MAIN}{tail}</body>") == TEXT


def test_named_furniture_stays_furniture():
    cards = "<div class='related'><article>A card of another story</article></div>"
    notes = "<div id='comments'><article class='comment'><p>I like this.</p></article></div>"
    for inner in (cards, notes, cards + notes):
        assert main_text(f"<body><article>{MAIN}</article>{inner}</body>") == TEXT
    assert main_text(f"<body><main>{MAIN}<div id='comments'><p>{BOX} {BOX}</p></div></main></body>") == TEXT
    assert main_text(f"<body><article>{MAIN}<p>So <math><mi>x</mi></math> holds.</p></article></body>") == f"{TEXT} So x holds."


@pytest.mark.parametrize("part", [
    "<header class='entry-header'><h1>A title</h1><p class=byline>By someone</p></header>", "<div class='post-header'>A title of it</div>",
    "<p class='share-price'>The price fell.</p>", "<div class='legal-history'>A law of old.</div>", "<p class='search-theory'>On search.</p>",
    "<p class='commentary'>On the above.</p>", "<p data-id='menu'>Plain words.</p>", "<p title='a hidden valley'>Plain words.</p>"])
def test_article_parts_that_look_like_furniture_stay(part):
    own = " ".join(re.sub(r"<[^>]*>", " ", part).split())
    for shell in ("<article>%s</article>", "<main>%s</main>", "<div role='main'>%s</div>"):
        assert main_text(f"<body>{shell % (part + MAIN)}</body>") == f"{own} {TEXT}", shell


@pytest.mark.parametrize("box", [
    "<ol class='commentlist'><li>%s</li></ol>", "<div id='responses'><p>%s</p></div>", "<div role='contentinfo'>%s</div>",
    "<div role='complementary'>%s</div>", "<div class='sideBar'>%s</div>", "<div class='side-bar left'>%s</div>", "<table class='navbox'><tr><td>%s</table>",
    "<div hidden>%s</div>", "<div style='color:red; display: none'>%s</div>", "<div class='CommentThread'>%s</div>", "<div id='shareButtons'>%s</div>"])
def test_furniture_by_role_compound_name_and_visibility(box):
    for shell in ("<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>"):
        assert main_text(f"<body>{shell % MAIN}{box % BOX}</body>") == TEXT
        assert main_text(f"<body>{shell % (MAIN + box % BOX)}</body>") == TEXT


ODD = [(1, None), (2, ""), (3, "   "), (4, "<"), (5, "<p"), (6, "plain words only"), (7, "<p>a<p>b<br>c"), (8, "</div></p>"),
       (9, "<!-- open"), (10, "<script>never closed <p>x</p>"), (11, "<p title=\"a>b\">q &lt;tag&gt; &#233; &eacute &nope;</p>"),
       (12, "<p>" + "word " * 200_000 + "</p>"), (13, "<div>" * 20_000 + "deep"), (14, "<p a='" * 3000), (6, "plain words only")]


def test_odd_pages(spark, tmp_path):
    frame = spark.createDataFrame([(i, None, h, "t", 1) for i, h in ODD], "page_id long, url string, html string, text string, n_chars int")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r for r in Q.op3_html_text(spark, str(tmp_path)).collect()}
    expected = {1: "", 2: "", 3: "", 6: "plain words only", 7: "a b c", 8: "", 9: "", 10: "", 11: "q <tag> é é &nope;", 13: "deep"}
    assert {k: found[k]["text"] for k in expected} == expected
    assert found[12]["n_chars"] == 5 * 200_000 - 1
    frame.where("false").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert Q.op3_html_text(spark, f"{tmp_path}/none").count() == 0


def test_signs_of_weights():
    w = weights()
    assert all(w[k] < 0 for k in w if not k.startswith("text")) and w["text:main"] > 0 > w["text:furniture"]


def test_best_run_against_all_runs():
    import random

    rng = random.Random(0)
    for _ in range(200):
        scores = [rng.choice([-2, -1, 1, 3]) for _ in range(rng.randrange(12))]
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        i, j = best_run(scores)
        assert sum(scores[i:j]) == best


def test_tokens_hold_the_whole_text():
    assert "".join(t for kind, _, t in tokens("a<b>b</b> c<i>d") if kind) == "ab cd"
