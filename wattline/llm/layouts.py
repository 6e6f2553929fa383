"""Labelled pages in many layouts: parts of a page in random order and nesting, their elements and names drawn from the lists below, marked by `data-main`.

The texts come from the caller, so that lengths and punctuation are those of the corpus.
"""

from __future__ import annotations

import random
from html import escape

# fixed word lists: names that sites give to the parts of a page
NAMES = {
    "main": "content main post entry article story body text page-content post-content entry-content article-body story-body post-body main-content markdown prose",
    "menu": "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs tabs pagination pager toc links",
    "header": "header masthead site-header top banner-top branding logo topbar hero-bar",
    "footer": "footer site-footer bottom colophon copyright legal credits imprint",
    "side": "sidebar side aside rail right-col secondary widget widget-area related related-posts recommended trending popular more-stories read-more",
    "notice": "notice cookie-notice cookie cookie-banner consent gdpr alert message announcement disclaimer paywall popup modal overlay warning",
    "advert": "ad ads advert adverts advertisement advertising ad-slot sponsor sponsored promo promotion banner teaser-ad partner dfp commercial",
    "form": "search search-form login signup subscribe newsletter contact-form poll survey filter",
    "comments": "comments comment-list commentlist comment discussion responses replies disqus reader-comments feedback respond reviews",
    "share": "share social sharing share-buttons follow tags tag-list byline-links post-meta meta author-box",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SEMANTIC = {"main": ["article", "main"], "menu": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "form": ["form"], "comments": ["section"], "notice": ["div", "aside"], "advert": ["div", "aside"], "share": ["div", "ul"]}


def _opened(rng: random.Random, part: str, semantic: bool) -> tuple[str, str]:
    tag = rng.choice(SEMANTIC[part]) if semantic else rng.choice(["div", "div", "div", "section", "td"])
    name = rng.choice(NAMES[part])
    if rng.random() < 0.2:
        name += " " + rng.choice(["col-8", "wrap", "clearfix", "container", "row", "inner", "box", "block"])
    bare = semantic and tag not in ("div", "section", "ul") and rng.random() < 0.5
    attribute = "" if bare else f' {rng.choice(["class", "class", "id"])}="{name}"'
    mark = f' data-main="{int(part == "main")}"'
    return (f"<table><tr><td{attribute}{mark}>", "</td></tr></table>") if tag == "td" else (f"<{tag}{attribute}{mark}>", f"</{tag}>")


def _phrase(rng: random.Random, texts: list[str], least: int, most: int) -> str:
    words = rng.choice(texts).split()
    n = rng.randint(least, most)
    at = rng.randint(0, max(0, len(words) - n))
    return escape(" ".join(words[at:at + n]) or "text")


def _links(rng: random.Random, texts: list[str], n: int) -> str:
    item = [f'<a href="/{i}">{_phrase(rng, texts, 1, 5)}</a>' for i in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" if rng.random() < 0.9 else f"<li>{x}" for x in item) + "</ul>" if rng.random() < 0.7 else " | ".join(item)


def _paragraphs(rng: random.Random, texts: list[str], n: int) -> list[str]:
    out = []
    for _ in range(n):
        t = escape(rng.choice(texts)) if rng.random() < 0.7 else _phrase(rng, texts, 1, 40)
        kind = rng.random()
        if kind < 0.75:
            out.append(f"<p>{t}</p>" if rng.random() < 0.9 else f"<p><b>{t}<br>")
        elif kind < 0.8:
            out.append(f"<h{rng.randint(2, 4)}>{_phrase(rng, texts, 1, 7)}</h2>")
        elif kind < 0.86:
            out.append("<ul>" + "".join(f"<li>{_phrase(rng, texts, 2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            out.append(f"<blockquote>{t}</blockquote>")
        elif kind < 0.96:
            out.append(f'<p>{t} <a href="/x">{_phrase(rng, texts, 1, 6)}</a> {_phrase(rng, texts, 3, 9)}</p>')
        else:
            out.append(f"<pre><code>{_phrase(rng, texts, 3, 30)}</code></pre>")
    return out


def page(rng: random.Random, texts: list[str]) -> str:
    """One labelled page."""
    semantic = rng.random() < 0.6

    def part(kind: str, body: str) -> str:
        a, b = _opened(rng, kind, semantic)
        return a + body + b

    def some(kind: str) -> str:
        n = rng.randint
        short, long = (lambda: _phrase(rng, texts, 1, 12)), (lambda: "".join(f"<p>{_phrase(rng, texts, 4, 60)}</p>" for _ in range(n(1, 3))))
        body = {
            "menu": lambda: _links(rng, texts, n(3, 9)),
            "header": lambda: rng.choice([f"<h1>{short()}</h1>", f"<div>{short()}</div>", f"<a href='/'>{short()}</a>"]) + (_links(rng, texts, n(2, 6)) if rng.random() < 0.5 else ""),
            "footer": lambda: rng.choice([f"&copy; {short()}", f"<p>{short()}</p><p>&copy; 2020 {short()}</p>", _links(rng, texts, n(2, 7)) + f"<small>{short()}</small>"]),
            "side": lambda: f"<h3>{short()}</h3>" + rng.choice([_links(rng, texts, n(2, 7)), long()]),
            "notice": lambda: rng.choice([long(), short()]) + rng.choice(["", "<button>OK</button>"]),
            "advert": lambda: rng.choice([short(), long(), f"<a href='/ad'>{short()}</a>", _phrase(rng, texts, 5, 60)]),
            "form": lambda: f"<label>{short()}</label><input name=q><button>{_phrase(rng, texts, 1, 2)}</button>" + rng.choice(["", f"<p>{short()}</p>", "<select><option>" + short() + "<option>" + short() + "</select>"]),
            "comments": lambda: f"<h3>{short()}</h3>" + "".join(rng.choice([f'<div class="comment"><b>{_phrase(rng, texts, 1, 2)}</b>{long()}</div>', f"<li>{_phrase(rng, texts, 3, 50)}</li>", long()]) for _ in range(n(1, 5))),
            "share": lambda: _links(rng, texts, n(1, 5)) + rng.choice(["", short()]),
        }[kind]()
        return part(kind, body)

    title = f"<h1>{_phrase(rng, texts, 2, 10)}</h1>"
    inside = _paragraphs(rng, texts, rng.choice([1, 1, 2, 3, 5, 8, 12]))
    if rng.random() < 0.85:
        inside.insert(0, title if rng.random() < 0.8 else f"<header>{title}</header>")
    for kind in rng.sample(["side", "notice", "advert", "form", "comments", "share", "menu", "footer"], rng.choice([0, 0, 0, 1, 2])):
        inside.insert(rng.randint(0, len(inside)), some(kind))
    before = [some(k) for k in rng.sample(["header", "menu", "notice", "advert", "form", "side"], rng.randint(1, 4))]
    after = [some(k) for k in rng.sample(["comments", "side", "share", "advert", "form", "notice", "footer"], rng.randint(0, 4))] + ([some("footer")] if rng.random() < 0.8 else [])
    main = part("main", "\n".join(inside))
    for _ in range(rng.choice([0, 0, 1, 2])):
        main = f"<div class='{rng.choice(['wrapper', 'container', 'layout', 'col', 'site', 'page', 'inner'])}'>{main}</div>"
    return f"<html><head><title>x</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
