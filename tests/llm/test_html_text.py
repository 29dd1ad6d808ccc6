import html
import re
import time

import pytest

from tessera.llm import html_text as H

TEXT = "Some longer words make up this paragraph, which goes on for a while."


def page(inside, head=""):
    return f"<!DOCTYPE html><html><head><title>No</title>{head}</head><body>{inside}</body></html>"


@pytest.mark.parametrize(
    "markup,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        (page(f"<article><h1>T</h1><p>{TEXT}</p></article>"), f"T\n\n{TEXT}"),
        (page(f"<nav><ul><li><a href=x>a</a></ul></nav><div class='ad'>Buy &amp; buy</div><article><h1>T</h1><p><b>{TEXT}<br><p>B &lt;c&gt; &eacute;&#233;</article><footer>f</footer>"), f"T\n\n{TEXT}\n\nB <c> éé"),
        (page("<script>var t='<p>x</p>'</script><article><p>a\n\t b<i>c</i>&nbsp; d</p></article>"), "a bc d"),
        (page(f"<div id=main><div class='post'><h1>T</h1><p>{TEXT}</p><p>{TEXT}</p></div><div id='comments'><p>{TEXT} {TEXT}</p></div></div><aside><p>{TEXT}</p></aside>"), f"T\n\n{TEXT}\n\n{TEXT}"),
        (page(f"<div>{'<a href=x>link words</a> ' * 30}</div><div><p>{TEXT}</p><p>{TEXT}</p></div>"), f"{TEXT}\n\n{TEXT}"),
        (page(f"<div class='cookie-notice'>We use cookies</div><form><p>{TEXT}</p></form><main><p>{TEXT}</p></main>"), TEXT),
        (page(f"<article><p>{TEXT}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>"), f"{TEXT}\n\none\n\ntwo\n\nx\n\ny"),
        (page(f"<article><p>{TEXT}")[:-14] + "</artic", TEXT),
        (page(f"<article><p>{TEXT}</p><p>cut &am")[:-14], f"{TEXT}\n\ncut &am"),
        (page(f"<header><p>{TEXT}</p></header><article><header><h1>T</h1></header><p>{TEXT}</p><div hidden>h</div><section class='related'>r</section></article>"), f"T\n\n{TEXT}"),
    ],
)
def test_pages(markup, want):
    assert H.main_text(markup) == want


@pytest.mark.parametrize("name", ["content no-sidebar", "page has-sidebar", "layout-sidebar-right", "search-result", "social-policy", "post-header", "related-work", "page search", "post share-enabled"])
@pytest.mark.parametrize("element", ["div", "form", "article"])
def test_wrappers_with_furniture_in_their_names_stay(name, element):
    inside = f"<h1>T</h1><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p>"
    aside = f"<div class=sidebar><a href=x>one</a> <a href=y>two</a></div><div class='cookie-notice'>We use cookies</div>"
    want = f"T\n\n{TEXT}\n\n{TEXT}\n\n{TEXT}"
    assert H.main_text(page(f"<div class='{name}'><{element}>{inside}</{element}>{aside}</div>")) == want
    assert H.main_text(page(f"<{element} class='{name}'>{inside}{aside}</{element}>")) == want


def test_names_inside_an_article_are_left_to_density():
    section = f"<section class='related-work'><h2>Before</h2><p>{TEXT} {TEXT}</p></section>"
    links = "<div class='share-buttons'><a href=x>Send to a friend</a> <a href=y>Print it</a></div>"
    got = H.main_text(page(f"<div class=post><div class='post-header'><h1>T</h1></div><p>{TEXT}</p>{section}{links}<p>{TEXT}</p></div>"))
    assert got == f"T\n\n{TEXT}\n\nBefore\n\n{TEXT} {TEXT}\n\n{TEXT}"


def test_comments_longer_than_the_article_are_no_content():
    got = H.main_text(page(f"<div class=post><h1>T</h1><p>{TEXT}</p><p>{TEXT}</p></div><div class=comments>{f'<p>{TEXT}</p>' * 20}</div>"))
    assert got == f"T\n\n{TEXT}\n\n{TEXT}"


def test_time_grows_with_length():
    def seconds(n):
        began = time.process_time()
        H.main_text(page("".join(f"<div class='a-nav-{i % 3}'><p>{TEXT[:20]}" for i in range(n))))
        H.main_text(page("<span>" * n + f"<div><li>{TEXT}" * (n // 4)))
        return time.process_time() - began

    seconds(2000)
    assert seconds(40_000) < 60 * max(seconds(2000), 0.02)
    assert H.main_text(page("<div>" * 50_000 + f"<p>{TEXT}</p>")) == TEXT


def test_hostile_pages_end():
    assert H.main_text("<div>" * 20_000 + "x") == "x"
    H.main_text('<a href="' * 3000)
    H.main_text("<p>" * 50_000)
    H.main_text("<" * 50_000)
    long = page("<article>" + f"<p>{TEXT}</p>" * 4000 + "</article>")
    assert H.main_text(long).count("\n\n") == 3999


def test_articles_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = {r.page_id: r for r in H.extract(pages).collect()}
    assert got.keys() == source.keys()
    for i, r in got.items():
        inside = re.split("</article>", source[i].html.partition("<article>")[2])[0]
        blocks = [html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(" ".join(b.split()) for b in blocks if b.strip()), i
        assert r.n_chars == len(r.text) and r.url == source[i].url


def test_nulls_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "x"), (None, "u", "<p>a</p>", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(pages).collect()) == [("1", "", 0), ("None", "a", 1), ("None", "a", 1)]
    assert H.extract(pages.limit(0)).count() == 0


LEAD = "<p>" + "Some words of the story that go on and on in many sentences. " * 8 + "</p>"
SAID = "<p>" + "I think that this is wrong and I say so at length here today. " * 6 + "</p>"


def test_comments_whose_name_only_has_the_word_are_left_out():
    for page in (f"<div class=post>{LEAD}</div><div class='user-comments'>{SAID * 8}</div>", f"<div class=post>{LEAD}<div id='comments-area'>{SAID * 8}</div></div>"):
        text = H.main_text(f"<html><body>{page}</body></html>")
        assert "the story" in text and "wrong" not in text
    assert "the story" in H.main_text(f"<body><div class='page has-comments'><h1>Head</h1>{LEAD}</div></body>")


def test_headlines_and_last_paragraphs_beside_the_body_stay():
    page = lambda x: H.main_text(f"<html><body>{x}</body></html>").split("\n\n")
    body = f"<div class=body>{LEAD * 3}</div>"
    assert page(f"<h1>The head line</h1>{body}")[0] == "The head line"
    assert page(f"{body}<div><p>That was all.</p></div>")[-1] == "That was all."
    assert page(f"<div><p>This is the lead.</p></div>{body}")[0] == "This is the lead."
    assert len(page(f"{body}<div>\u00a9 2024 Example. All rights reserved.</div><div>Home</div>")) == 3
    assert page(f"<div>Site note here.</div><article><h1>H</h1>{LEAD}</article><div>Other words.</div>") == ["H", LEAD[3:-4].strip()]


def test_a_notice_name_wraps_when_nothing_else_is_left():
    assert H.main_text(f"<body><div class=newsletter>{LEAD}</div></body>") == LEAD[3:-4].strip()
    assert "story" not in H.main_text(f"<body><div class=newsletter>{LEAD}</div><div class=post>{SAID}</div></body>")


def test_many_siblings_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        H.main_text("<body>" + f"<div class=body>{LEAD}</div>" + "<div>And so on.</div>" * n + "</body>")
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05)
