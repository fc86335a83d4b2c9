"""Markup that is broken or wraps the article, and columns that clash in the stage that keeps one document a group."""

import random

import pytest

from mendframe.llm import html_extract, media, ngram_join

STORY = "<article><p>The long story of the day.</p><p class='share-price'>Shares fell.</p><p class='notice-of-death'>He died.</p></article>"
WRAPPERS = [
    "<div class='layout has-sidebar'>%s</div>", "<div id=page class=no-sidebar>%s</div>", "<div class='ad-free wrapper'><main>%s</main></div>", "<form id=aspnetForm><div>%s</div></form>", "<header>%s</header>", "<div class=menu><div>%s</div></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_the_article(wrapper):
    assert html_extract.parts_of(wrapper % STORY) == (["The long story of the day.", "Shares fell.", "He died."], [True] * 3)


def test_what_stands_beside_goes():
    page = STORY + "<div class='site-footer'>foot</div><nav>a b</nav><section class=comments><article>Me too</article></section><div class='cookie-bar'>We use cookies</div><form><input>Search</form><aside>side</aside><div class='related-posts'><p>More</p></div>"
    assert html_extract.parts_of(page)[0] == ["The long story of the day.", "Shares fell.", "He died."]
    assert html_extract.parts_of("<div class=footer>only a footer here</div>")[0] == []
    assert html_extract.parts_of(f"<form><p>{'Words of the page. ' * 9}</p></form><div class=footer>foot</div>")[0] == [("Words of the page. " * 9).strip()]


def test_broken_markup_is_read(spark):
    assert html_extract.parts_of("<p>x<![foo[bar]]>b</p><p>a<![ 1]>c<!ELEMENT d></p>")[0] == ["xb", "ac"]
    assert [e["text"] for e in media.elements_of("<p>a<![foo[bar]]>b</p><![ 1]>c")] == ["ab", "c"]
    r = random.Random(1)
    bits = ["<", "!", "[", "]", ">", "<![", "<![CDATA[", "]]>", "<?", "--", "<!--", "a", "p", "/", "</p>", "<p>", "&#x", "&#99999999999;", "&amp", '"', "'", "=", "<div class=", "<article>", "\0", "<!DOCTYPE", "-->", "</", "<svg", "é"]
    for _ in range(20000):
        x = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        html_extract.parts_of(x)
        media.elements_of(x)
    pages = spark.createDataFrame([(1, "http://h/1", "<p>a<![foo[bar]]>b"), (2, None, None)], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_extract.extract(pages).collect()} == {1: "ab", 2: ""}


def test_one_document_a_group_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 9, 8, 7, "x"), (1, "a b c d e f", 9, 8, 7, "y"), (2, "a b c d e f", 9, 8, 7, "z"), (3, "other words", 9, 8, 7, "x"), (None, "t", 9, 8, 7, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _nth int, n int, doc string")
    kept = ngram_join.distinct_documents(df)
    assert kept.columns == df.columns and sorted(((r.doc_id or 0), r["_id"], r["_nth"], r.n) for r in kept.collect()) == [(0, 9, 8, 7), (1, 9, 8, 7), (3, 9, 8, 7)]
