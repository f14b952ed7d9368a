"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score by the elements they
are in, above zero in running text and below it in page furniture; tags score
below zero, most where furniture begins. The weights come from pages labelled by
hand. One linear scan finds the contiguous run with the highest sum; the text is
the run's words that score above zero, blocks apart by one space. Furniture between
parts of the main text counts once, however long it is, and an element that
holds the main text is no furniture, whatever its name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by their part in a page, and names that furniture goes by.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "img"}
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "svg",
             "canvas", "object", "audio", "video", "fieldset", "datalist"}
# Names that say furniture wherever they stand in a longer name ...
SURE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "sponsor", "sponsored", "nav",
    "navbar", "navbox", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "masthead", "topbar", "toolbar", "comment",
    "comments", "disqus", "cookie", "cookies", "gdpr", "popup", "newsletter", "pagination", "pager", "contentinfo",
    "complementary", "aside", "commentlist", "commentform", "responses",
}
# ... others only with each other or with names of boxes: not in share-price or legal-history.
FURNITURE_NAMES = SURE_NAMES | {
    "promo", "promotion", "banner", "menu", "widget", "footer", "foot", "header", "reply", "replies", "respond", "notice",
    "consent", "alert", "modal", "overlay", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related",
    "recommended", "recommendations", "copyright", "legal", "disclaimer", "form", "skip",
}
BOX_NAMES = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "c", "col", "column", "container", "content", "div", "entry",
    "fixed", "global", "group", "icon", "icons", "id", "inner", "item", "items", "js", "left", "link", "links", "list", "main",
    "more", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "side", "site", "small",
    "sticky", "stories", "text", "title", "to", "top", "tools", "wrap", "wrapper", "article", "articles", "story", "the", "us",
}
HEADINGS = {"header", "masthead", "head"}  # inside the article, or with its names, these hold its title
OWN_NAMES = {"entry", "post", "article", "story"}
MAIN = {"article", "main"}
MAIN_ROLES = {"article", "main"}
MAY_WRAP = {"form", "fieldset"}  # furniture that may hold a whole page

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|</?[a-zA-Z][^\s/>]*+(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"\shidden(?=[\s/>=])", re.IGNORECASE)
_UNSEEN = re.compile(r"""\sstyle\s*=\s*["'][^"'>]*\bdisplay\s*:\s*none""", re.IGNORECASE)

_ROLE = re.compile(r"""(?<![\w-])role\s*=\s*["']?\s*(?:article|main)\b""", re.IGNORECASE)

_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}

TAG, TEXT = 0, 1


def _names_furniture(name: str, inside_main: bool) -> bool:
    """Whether one class, id or role says furniture, by its parts or written as one word (sideBar, side-bar)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    whole = "".join(parts)
    if whole in HEADINGS or HEADINGS & set(parts):
        if inside_main or OWN_NAMES & set(parts):
            return False
    if whole in FURNITURE_NAMES or SURE_NAMES & set(parts):
        return True
    if whole.startswith("comment") and not whole.startswith("commentar"):
        return True
    known = FURNITURE_NAMES & set(parts)
    return bool(known) and set(parts) <= FURNITURE_NAMES | BOX_NAMES


def _kind(name: str, tag: str, inside_main: bool) -> str:
    """The part an element plays: furniture, main or plain."""
    if name in FURNITURE or (name == "header" and not inside_main):
        return "furniture"
    if name in ("body", "html"):
        return "plain"
    if "hidden" in tag.lower() and _HIDDEN.search(_QUOTED.sub('""', tag)) or "none" in tag and _UNSEEN.search(tag):
        return "furniture"
    names = [n for groups in _NAMES.findall(tag) for g in groups for n in g.split()]
    if any(_names_furniture(n, inside_main) for n in names):
        return "furniture"
    return "main" if name in MAIN or MAIN_ROLES & {n.lower() for n in names} and _ROLE.search(tag) else "plain"


Token = tuple[int, str, str]


def tokens(page: str) -> list[Token]:
    """(TAG, key, separator) and (TEXT, context key, text) of a page in order.

    Keys are what weights are learned for: a tag's part and whether it opens or
    closes, a text's nearest telling element. Elements left open are closed as
    far as later tags tell; raw elements and comments are passed over whole.
    """
    out, wrapping = _scan(page, frozenset())
    return _scan(page, wrapping)[0] if wrapping else out


def _scan(page: str, spared: frozenset[int]) -> tuple[list[Token], frozenset[int]]:
    """Tokens, where the elements at ``spared`` are no furniture, and the places of elements that hold the main text.

    Of elements called furniture by their name, these are the ones around most of what
    is in articles; where there is none, around the heading and most of the
    page, or four fifths of a page without a heading.
    """
    out: list[Token] = []
    stack: list[tuple[str, str]] = []  # element, part
    opened: Counter[str] = Counter()  # elements on the stack
    at = furniture = main = 0
    sure = 0  # open elements that are furniture for certain
    named = 0  # open main elements that go by a furniture name
    held = [0, 0, 0]  # words outside such furniture, those of them in main elements without a furniture name, headings
    doubtful: dict[int, tuple[int, bool, bool, list[int]]] = {}  # by depth: place, inside main, main itself, held so far
    done: list[tuple[int, bool, bool, list[int]]] = []

    def context() -> str:
        return "text:furniture" if furniture else "text:main" if main else "text:plain"

    def pop() -> str:
        nonlocal furniture, main
        element, part = stack.pop()
        opened[element] -= 1
        furniture -= part == "furniture"
        main -= part == "main"
        if part == "furniture":
            leave(len(stack))
        return part

    def leave(depth: int) -> None:
        nonlocal sure, named
        if depth in doubtful:
            place, inside, itself, before = doubtful.pop(depth)
            named -= itself
            done.append((place, inside, itself, [b - a for a, b in zip(before, held, strict=True)]))
        else:
            sure -= 1

    def see(text: str) -> None:
        if not sure:
            n = len(text.split())
            held[0] += n
            held[1] += n if main else 0

    while found := _TOKEN.search(page, at):
        if found.start() > at:
            out.append((TEXT, context(), page[at:found.start()]))
            see(out[-1][2])
        tag, at = found[0], found.end()
        if tag[1] in "!?":
            continue
        name, closing = _NAME.match(tag)[1].lower(), tag[1] == "/"
        space = "" if name in INLINE else " "
        if closing:
            part = "plain"
            if opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                part = pop()
            out.append((TAG, f"close:{part}", space))
            continue
        while stack and stack[-1][0] in SELF_CLOSING.get(name, ()):
            pop()
        part = _kind(name, tag, main > 0)
        if found.start() in spared:
            part = "main" if name in MAIN else "plain"
        held[2] += name == "h1" and not sure
        out.append((TAG, f"open:{part}", space))
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
        elif name not in VOID and not tag.endswith("/>"):
            stack.append((name, part))
            opened[name] += 1
            if part == "furniture":
                if name in MAY_WRAP or name not in FURNITURE and name != "header":
                    doubtful[len(stack) - 1] = (found.start(), main + named > 0, name in MAIN, held.copy())
                    named += name in MAIN
                else:
                    sure += 1
            furniture += part == "furniture"
            main += part == "main"
    if at < len(page):
        out.append((TEXT, context(), page[at:]))
        see(out[-1][2])
    for depth in list(doubtful):
        leave(depth)
    words, in_main, headings = held

    def wraps(inside: bool, itself: bool, own: list[int]) -> bool:
        if inside:
            return False
        if in_main:
            return 2 * own[1] >= in_main
        if headings and not own[2]:
            return False
        return 2 * own[0] > words if own[2] or itself else 5 * own[0] >= 4 * words > 0

    return out, frozenset(place for place, inside, itself, own in done if wraps(inside, itself, own))


# Labelled by hand: what lies between [[ and ]] is the main text.
LABELLED = (
    """<html><head><title>A page</title><style>p{}</style></head><body><header><div class="logo">Site name</div>
    <nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav></header>
    <div class="ad">Buy this now and save money on all our offers today</div>
    <article>[[<h1>The heading of it</h1><p>Some <b>running</b> text that goes on for a while, with <a href="x">a link</a>.</p>
    <p>And a second paragraph, which is a little longer than the first one was, or so it seems.</p>]]</article>
    <aside>Most read today: five things you should know</aside><footer>&copy; Site name. All rights reserved.</footer></body></html>""",
    """<body><div id="menu"><a href="1">One</a> <a href="2">Two</a></div><div class="cookie-notice">We use cookies to serve
    you better. <button>Accept</button></div><div class="post">[[<h2>Title</h2><p>First part of the story, told in plain words.</p>
    <ul><li>a point that is made</li><li>and another</li></ul><p>Last part of the story, also in words.</p>]]</div>
    <div id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thank you.</p></div>
    <form><label>Your name</label><input></form></div><div class="footer">Contact us</div></body>""",
    """<body><div class="sidebar"><h4>Links</h4><a href="q">Somewhere else</a></div><main>[[<h1>Report</h1><p>It was found that
    the thing works, and that it works well in all the cases that were tried.</p>]]<div class="share">Share this</div>
    <form>Search <input></form>[[<p>A table follows.</p><table><tr><td>one</td><td>two</td></tr></table>]]</main>
    <footer><p>Imprint, privacy and terms of use of this site</p></footer></body>""",
    """<body><nav><a href="a">A</a><a href="b">B</a></nav><div><div>[[<p>Text without any names on its boxes, but
    with enough words to be seen for what it is by anyone.</p><blockquote>And a quote.</blockquote>]]</div></div>
    <div class="related">Read also: another story from last week</div></body>""",
)


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Log odds of being main text by key, from the labelled pages; tags never score above zero."""
    inside, outside = Counter(), Counter()
    for page in LABELLED:
        main = False
        for kind, key, text in tokens(page):
            if kind == TAG:
                (inside if main else outside)[key] += 1
                continue
            for piece in re.split(r"(\[\[|\]\])", text):
                if piece in ("[[", "]]"):
                    main = piece == "[["
                else:
                    (inside if main else outside)[key] += len(piece.split())
    score = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside | outside}
    return {k: min(s, -0.05) if not k.startswith("text") else s for k, s in score.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the highest sum; the first of equal ones; empty where none is above zero."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def _bounded(parts: list[Token], scores: list[float], most: float) -> list[float]:
    """Scores where furniture between two parts of the main text costs ``most`` at the most, as its two tags do.

    Main text is what is in main elements, or all text outside furniture where there are none.
    """
    for own in ("text:main", "text:plain"):
        places = [i for i, (kind, key, text) in enumerate(parts) if kind == TEXT and key == own and not text.isspace()]
        if places:
            break
    out = list(scores)
    i, last = (places[0], places[-1]) if places else (0, 0)
    while i < last:
        if scores[i] > 0:
            i += 1
            continue
        end = i
        while end < last and scores[end] <= 0:
            end += 1
        if any("furniture" in key for _, key, _ in parts[i:end]) and sum(scores[i:end]) < most:
            out[i:end] = [most] + [0.0] * (end - i - 1)
        i = end
    return out


def main_text(page: str | None) -> str:
    """The page's main text, empty if there is none; references decoded, white space as single spaces."""
    if not page:
        return ""
    weigh, parts = weights(), tokens(page)
    lowest = min(weigh.values())
    scores = [
        weigh.get(key, lowest) * (len(text.split()) if kind == TEXT else 1) for kind, key, text in parts
    ]
    start, end = best_run(_bounded(parts, scores, weigh["open:furniture"] + weigh["close:furniture"]))
    out = []
    for (kind, _, text), score in zip(parts[start:end], scores[start:end], strict=True):
        if kind == TAG:
            out.append(text)
        elif score > 0:
            out.append(html.unescape(text))
        elif text != text.strip() or score:
            out.append(" ")
    return " ".join("".join(out).split())


@F.pandas_udf(T.StringType())
def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_text(page: Column) -> Column:
    """Main text of an HTML column; empty for null and empty pages and those without running text."""
    return _texts(F.coalesce(page, F.lit("")))
