"""HTML blocks, the random field against enumeration, main texts of pages."""

import itertools
import random

import numpy as np
import pytest

from wattline.llm import crf, extraction
from wattline.llm.base import tuned
from wattline.llm.dom import blocks, names_of
from wattline.llm.layouts import page


def texts(html):
    return [b.text for b in blocks(html)]


@pytest.mark.parametrize(("html", "want"), [
    ("", []),
    ("just text", ["just text"]),
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p><b>a &amp; b<br>c<p>d&nbsp;&eacute;&#233;&#xE9;&copy;", ["a & b c", "d ééé©"]),
    ("<ul><li>one<li>two <i>x</i></ul>tail", ["one", "two x", "tail"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>4", ["1", "2", "3", "4"]),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style><!-- <p>no</p> --><p>y", ["x", "y"]),
    ("<title>t</title><SCRIPT>a</SCRIPT><p CLASS=\"a>b\">x</P>", ["x"]),
    ("<p>a</b></div></section>b</p>", ["a", "b"]),
    ("<p>unclosed <a href='x", ["unclosed <a href='x"]),
    ("<p>x<!-- never closed <p>y", ["x"]),
    ("<script>never closed <p>y", []),
    ("5 < 6 & 7 > 3 <3", ["5 < 6 & 7 > 3 <3"]),
    ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", ["a", "b", "c", "1", "2"]),
    ("<p>\n a\t b   c </p><p> </p>", ["a b c"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_paths_links_and_names():
    b = list(blocks('<body><div class="siteNav main_menu2" id=TOP><a href=x>abc</a> d</div><p>e</body>'))
    assert [t for t, _ in b[0].path] == ["body", "div"] and b[0].path[1][1] == ("site", "nav", "main", "menu", "2", "top")
    assert b[0].linked == 3 and b[1].linked == 0 and [t for t, _ in b[1].path] == ["body", "p"]
    assert names_of("data-x=1") == ()
    assert len(list(blocks("<div>" * 3000 + "deep" + "</div>" * 3000))) == 1


def random_chains(rng, n=6, size=12):
    lengths = [int(x) for x in rng.integers(0, 6, n)]
    feats = [[int(f) for f in rng.integers(0, size, rng.integers(1, 4))] for _ in range(sum(lengths))]
    return feats, lengths, crf.Chains(feats, lengths), rng.integers(0, 2, sum(lengths))


def score(m, feats, y):
    s = sum(m.weight[f].sum() for f, v in zip(feats, y, strict=True) if v)
    return s + (m.start[y[0]] if len(y) else 0) + sum(m.transition[a, b] for a, b in itertools.pairwise(y))


def test_field_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(10):
        feats, lengths, x, y = random_chains(rng)
        m = crf.Model(12)
        m.weight, m.transition, m.start = rng.normal(size=12), rng.normal(size=(2, 2)), rng.normal(size=2)
        got, total, at = crf.viterbi(m, x), 0.0, 0
        for n in lengths:
            mine = feats[at:at + n]
            every = {v: score(m, mine, v) for v in itertools.product((0, 1), repeat=n)}
            assert tuple(got[at:at + n]) == max(every, key=every.get)
            total += score(m, mine, tuple(y[at:at + n])) - np.logaddexp.reduce(list(every.values()))
            at += n
        value, grads = crf.likelihood(m, x, y)
        assert value == pytest.approx(total / len(lengths))
        for part, g in zip((m.weight, m.transition, m.start), grads, strict=True):
            for i in np.ndindex(part.shape):
                part[i] += 1e-5
                up = crf.likelihood(m, x, y)[0]
                part[i] -= 2e-5
                down = crf.likelihood(m, x, y)[0]
                part[i] += 1e-5
                assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


ARTICLE = "<article><h1>Title here</h1><p>A first paragraph, with some words in it.</p><p>Second one &amp; last.</p>{}</article>"
PAGE = "<html><head><title>no</title></head><body><nav><a href=/>Home</a> <a href=/b>News</a></nav>{}<footer>&copy; 2020 me</footer></body></html>"
MAIN = "Title here\n\nA first paragraph, with some words in it.\n\nSecond one & last."


@pytest.fixture(scope="module")
def model():
    return extraction.learned([PAGE.format(ARTICLE.format("")) for _ in range(20)])


def test_pages_in_other_layouts(model):
    side = '<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One link</a><li><a href=2>Another link</a></ul></aside>'
    comments = '<div id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this, it is good.</p></div></div>'
    advert = '<div class="ad">Buy this thing now.</div>'
    form = '<form class="search"><label>Search</label><button>Go</button></form>'
    notice = '<div class="cookie-notice"><p>We use cookies on this site, as all do.</p><button>OK</button></div>'
    for extra in ("", side, comments, advert, form, notice, side + comments, comments + advert):
        html = PAGE.format(notice + ARTICLE.format("") + extra)
        assert extraction.main_texts([html], model, {}, {}) == [MAIN], extra
    plain = PAGE.format('<div class="header"><a href=/>Site</a></div><div class="post-content">' + ARTICLE.format("").replace("article", "div") + "</div>" + side + comments)
    assert extraction.main_texts([plain], model, {}, {}) == [MAIN]


def test_held_out_accuracy(model):
    rng, good, total = random.Random(77), 0, 0
    for _ in range(150):
        found = list(blocks(page(rng, ["Some words of a text, long enough to be cut.", "Another sentence stands here. It has a friend."] + extraction.PLAIN)))
        label = crf.viterbi(model, crf.Chains(extraction.features(found, {}), [len(found)]))
        good += sum(int(a) == b.label for a, b in zip(label, found, strict=True))
        total += len(found)
    assert good / total > 0.97


def test_table(spark):
    long = PAGE.format("<article>" + "<p>Word after word, and so on it goes.</p>" * 30_000 + "</article>")
    rows = [(1, "u1", PAGE.format(ARTICLE.format(""))), (1, "u1", PAGE.format(ARTICLE.format(""))), (2, None, None), (None, "u3", ""), (4, "u4", "<nav>only a menu</nav>"), (5, "u5", long)]
    rows += [(10 + i, "u", PAGE.format(ARTICLE.format(f"<p>More words, {i} of them.</p>"))) for i in range(30)]
    df = tuned(spark).createDataFrame([(*r, 7, "clash") for r in rows], "page_id bigint, url string, html string, n_chars int, text string").repartition(3)
    out = extraction.main_text(df).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and sum(r.page_id == 1 for r in out) == 2
    assert got[1].text == MAIN and got[1].n_chars == len(MAIN) and got[1].url == "u1"
    assert (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None) and got[None].text == "" and got[4].text == ""
    assert got[5].text == "\n\n".join(["Word after word, and so on it goes."] * 30_000)
    assert all(got[10 + i].text == f"{MAIN}\n\nMore words, {i} of them." for i in range(30))
    assert extraction.main_text(df.limit(0)).collect() == []
