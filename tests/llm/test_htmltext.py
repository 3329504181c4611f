import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shapewright.llm import htmltext
from shapewright.llm.htmltext import main_text

P1 = "The old bridge over the river was closed for the winter, and the people of the town had to take the long way round to the market."
P2 = "It was only in the spring that the workers came back to the river, and by the end of the month the bridge was open to the town again."
P3 = "Nobody in the town could say who had paid for the stones, but the mayor was seen at the quarry, and that was enough for most."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a='<p>no</p>'</script></head><body>{body}</body></html>"


def test_article_element_with_short_blocks():
    got = main_text(page(f"<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy the best of the best now.</div><article><h1>Title</h1><p>{P1}<p>Yes.</p><p>{P2}</p></article><footer>&copy; site</footer>"))
    assert got == f"Title\n{P1}\nYes.\n{P2}"


def test_no_article_element():
    body = f"<div id=header><a href=/>Site name</a></div><div class='sidebar-left'><p>{P3}</p></div><div><h2>On the bridge</h2><p>{P1}</p><p>So it was.</p><p>{P2}</p></div><div class=comments><p>{P3}</p></div><div>Terms | Imprint</div><form><p>{P3}</p><input></form><footer><p>{P3}</p></footer>"
    assert main_text(page(body)).split("\n")[:4] == ["On the bridge", P1, "So it was.", P2]
    assert P3 not in main_text(page(body))


def test_furniture_inside_the_article_goes():
    body = f"<article><header><h1>T</h1></header><p>{P1}</p><aside>See also the rest</aside><div class='share'>Share this</div><form>Mail <button>Go</button></form><p>{P2}</p><section id='comments'><p>{P3}</p></section></article>"
    assert main_text(page(body)) == f"T\n{P1}\n{P2}"


@pytest.mark.parametrize("name", ["notice", "cookie-bar", "userComments", "sitefooter", "mainmenu", "ad", "ad-slot-3", "post-comments", "sidebar2", "newsletter_signup", "role-menu"])
def test_names_of_furniture(name):
    assert main_text(page(f"<div class='article-body'><p>{P1}</p><div class='{name}'><p>{P3}</p></div><p>{P2}</p></div>")) == f"{P1}\n{P2}"


@pytest.mark.parametrize("name", ["story", "headline", "shadow", "article-header", "lead", "navy"])
def test_other_names_are_no_furniture(name):
    assert main_text(page(f"<article><p>{P1}</p><div class='{name}'><p>{P3}</p></div></article>")) == f"{P1}\n{P3}"


def test_links_count_against_a_block():
    body = f"<div><p>{P1}</p><p><a href=1>{P3}</a> <a href=2>{P3}</a></p><p>With <a href=3>one link</a> in it: {P2}</p></div>"
    assert main_text(page(body)) == f"{P1}\nWith one link in it: {P2}"


def test_references_and_white_space():
    assert main_text("<article><p>a &amp; b &lt;c&gt; &#233;&#x41;&nbsp;&copy d</p></article>") == "a & b <c> éA © d"
    assert main_text("<article><p>  x\n\t y <b>z</b>\r\n</p><p> \n </p></article>") == "x y z"


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<", "<"), ("<article><p>a < b and 3<4</article>", "a < b and 3<4"), ("<article>x<!-- never closed", "x"), ("<article>x<script>never closed", "x"),
    ("<article><p class=x\">a</p><p>b \"c\"</p></article>", "a\nb \"c\""), ("<article><p title='>'>q</p></article>", "q"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article><br/>a<br>b<hr>c</article>", "a\nb\nc"),
    ("<article></p></div>still</article>", "still"), ("<article><table><tr><td>1</td><td>2</td></tr></table></article>", "1\n2"),
])
def test_small_cases(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("whole", ["<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "x<br>" * 20_000, "<b><div>" * 20_000 + "</b>" * 20_000, "<math>" + "<annotation>" * 20_000, "<div class=ad>" * 20_000 + "<p>y</p>" * 20_000, "<ul>" * 20_000 + "</li>" * 20_000])
def test_deep_pages_cost_no_more_than_their_length(whole):
    t = time.time()
    main_text(whole)
    assert time.time() - t < 4


@pytest.mark.parametrize("unit", ["<", "<p ", "<a href=\"", "<!--", "<b><i>", "</p>", "<div>", "&", "<p a='", "<x y=\"\" "])
def test_bad_markup_costs_no_more_than_its_length(unit):
    t = time.time()
    main_text(unit * 20_000)
    assert time.time() - t < 8


def of_article(html: str) -> str:
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(htmltext.entities.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1)>", inner))
    return "\n".join(x for x in parts if x)


SF = "/root/testdata/sf0.01"


def pages_of(spark) -> dict[int, str]:
    return {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_query_against_the_pages_own_markup(spark):
    html = pages_of(spark)
    got = htmltext.op7(spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == of_article(html[r.page_id]) and r.n_chars == len(r.text)


def test_no_article_element_is_needed(spark):
    for html in pages_of(spark).values():
        assert main_text(html.replace("<article>", "<div>").replace("</article>", "</div>")) == of_article(html)


def test_hardly_any_name_is_needed(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "MARKS", frozenset())
    monkeypatch.setattr(htmltext, "BEGIN", ("\0",))
    monkeypatch.setattr(htmltext, "END", ("\0",))
    html = pages_of(spark).values()
    assert sum(main_text(x) != of_article(x) for x in html) <= 0.02 * len(html)


NAMES = "Bridgework Construction, Riverside Infrastructure Works, Northern Quarrying Company, Eastern Stonemasons Association, Municipal Engineering Office"

#: Blocks without a name or element that tells: what stays is told by densities and neighbours.
PLAIN = f"<div><h2>News</h2><p>Yes.</p><p>{P1}</p><p>So.</p><p>{P2}</p><div><a href=1>One thing</a> | <a href=2>Another</a></div></div><div><p>{NAMES}, {NAMES}, {NAMES}</p><span>Tags</span></div><ul><li><a href=3>Third</a></li><li>Fourth</li></ul>"


@pytest.mark.parametrize("rule", ["stopped", "LINKS", "LONG", "inherited"])
def test_each_rule_decides(rule, monkeypatch):
    before = main_text(page(PLAIN))
    assert before.split("\n")[:5] == ["News", "Yes.", P1, "So.", P2]
    off = {"stopped": lambda text: True, "LINKS": 9.0, "LONG": 10**9, "inherited": lambda found, first: [x is True for x in first]}[rule]
    monkeypatch.setattr(htmltext, rule, off)
    assert main_text(page(PLAIN)) != before


def plainly(found, first):
    """The second pass once more, block by block."""
    out = list(first)
    for headings in (True, False):
        known = list(out)
        for i, b in enumerate(found):
            if known[i] is not None or b.heading != headings:
                continue
            low = high = None
            for near in (lambda j: found[j].parent == b.parent, lambda j: True):
                low = next((j for j in range(i - 1, -1, -1) if known[j] is not None and near(j)), None)
                stop = len(found) if headings else next((j for j in range(i + 1, len(found)) if found[j].heading), len(found))
                high = next((j for j in range(i + 1, stop) if known[j] is not None and near(j)), None)
                if low is not None or high is not None:
                    break
            if headings and high is not None:
                low = None
            if low is None and high is None:
                out[i] = None if headings else False
            elif low is None or high is not None and high - i < i - low:
                out[i] = known[high]
            elif high is None or i - low < high - i or known[low] == known[high]:
                out[i] = known[low]
            else:
                out[i] = b.text.endswith(".")
    return [bool(x) for x in out]


@given(st.lists(st.tuples(st.sampled_from(["a.", "b"]), st.booleans(), st.integers(0, 2), st.sampled_from([True, False, None, None])), max_size=14))
def test_second_pass_against_a_plain_one(rows):
    found = [htmltext.Block(text, heading, parent, 0, False, 0) for text, heading, parent, _ in rows]
    first = [label for *_, label in rows]
    assert htmltext.inherited(found, first) == plainly(found, first)


def test_extra_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, "<article>a</article>", "own", 2.0)] * 2, "page_id long, url string, html string, main_text string, x double")
    got = htmltext.extract(pages).collect()
    assert [(r.main_text, r.x, r.url) for r in got] == [("a", 2.0, None)] * 2
    assert htmltext.extract(pages.limit(0)).collect() == []


LAYOUTS = ["right-sidebar", "no-sidebar", "has-header", "menu-open", "with-sidebar", "hasComments"]


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("made", [
    "<html class='{0}'><body>{1}</body></html>", "<html><body class='{0}'>{1}</body></html>", "<body><div class='{0}'>{1}</div><p>Terms | Imprint</p></body>",
    "<body><main class='{0}'><h1>T</h1><div id='{0}'>{1}</div></main></body>", "<body><form class='{0}'>{1}</form></body>",
])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_around_the_text_lose_nothing(name, made, tag):
    got = main_text(made.format(name, f"<nav><a href=/>Home</a></nav><{tag}><p>{P1}</p><p>{P2} {P3}</p><div class='share'>Share this</div></{tag}><footer>&copy; site</footer>")).split("\n")
    assert [x for x in got if x not in ("T", "Terms | Imprint", "Share this")] == [P1, f"{P2} {P3}"]


def test_articles_inside_furniture_beside_the_article_go():
    other = f"<article><p>{P3} {P3}</p></article>"
    body = f"<div class='sidebar'>{other}</div><article><p>{P1} {P2}</p></article><section class='comments'>{other}</section><div class='related'>{other}</div>"
    assert main_text(page(body)) == f"{P1} {P2}"
    assert main_text(page(f"<div><p>{P1} {P2}</p></div><section class='comments'>{other}</section>")) == f"{P1} {P2}"
    assert main_text(page("<nav><a href=/>Home</a></nav><div class='menu'>Terms</div><footer>&copy; site</footer>")) == ""


@pytest.mark.parametrize("tag", ["article", "main"])
def test_captions_formulas_and_references_stay(tag):
    refs = "".join(f"<li><a href={i}>A paper on bridge number {i}</a>, 1990</li>" for i in range(6))
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='application/x-tex'>E=m<p></annotation></semantics></math>"
    body = f"<{tag}><p>{P1}</p><figure><img src=x><figcaption>The bridge in spring</figcaption></figure><p>So {formula} holds.</p><p>{P2}</p><aside>See also</aside><ul>{refs}</ul></{tag}><footer>&copy; site</footer>"
    assert main_text(page(body)) == "\n".join([P1, "The bridge in spring", "So E=m holds.", P2, *[f"A paper on bridge number {i}, 1990" for i in range(6)]])
