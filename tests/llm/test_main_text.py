import html
import random
import time

import pytest

from carelake.llm.html_main_text import _attributes, main_text

ART = "This is a full article paragraph with quite a few words in it so that the reader will surely see it as content and keep it. " * 3
TEXT = ART.strip()


@pytest.mark.parametrize("page,want", [
    (f'<p title="The hidden truth">{ART}</p>', TEXT), (f'<article data-slug="hidden-gems"><p>{ART}</p></article>', TEXT), (f'<div data-url="/hidden/x"><p>{ART}</p></div>', TEXT),
    (f'<p data-id="header">{ART}</p>', TEXT), (f'<div class="has-sidebar"><p>{ART}</p></div>', TEXT), (f'<div class="legal-news"><p>{ART}</p></div>', TEXT),
    (f"<p title=don't>{ART}</p><p>it's</p>", TEXT + " it's"), (f"<article><p>{ART}<![CDATA[a > b]]> end</p></article>", TEXT + " a > b end"),
    (f'<article><p>{ART}</p></article><div id="responses"><p>{ART}</p></div>', TEXT), (f'<article><p>{ART}</p></article><div class="related"><article><h2>Teaser</h2><p>Short teaser text</p></article></div>', TEXT),
    (f'<div class="elementor-widget-container"><p>{ART}</p></div>', TEXT), (f'<div class="widget"><article><p>{ART}</p></article></div><div class="site-footer">x y</div>', TEXT),
    (f'<article><p>{ART}</p></article><ul class="comment-list"><li>{ART * 4}</li></ul>', TEXT), (f"<article><p hidden>gone</p><p>{ART}</p></article>", TEXT),
    (f'<article><p>{ART}</p><div style="visibility: hidden">{ART}</div></article>', TEXT), (f"<p>{ART}</p><p x=\"unclosed>tail", TEXT + " tail"), (f"<article><p>{ART}<!-->seen</p></article>", TEXT + " seen"),
    (f"<article><p>{ART} if a <b and c < d</p></article>", TEXT + " if a <b and c < d"), (None, ""), ("", ""), ("<nav>menu</nav>", ""),
])
def test_pages(page, want):
    assert main_text(page and f"<html><body>{page}</body></html>") == want


def test_attributes():
    read = lambda t: _attributes(t, 0)
    assert read(""" a b=1 C="x>y" d='it"s' e = f/g h=don't a=2 />z""") == ({"a": "", "b": "1", "c": "x>y", "d": 'it"s', "e": "f/g", "h": "don't"}, 46, True)
    assert read(' a="x>rest')[0]["a"] == "" and read(" a b") is None and read(" a <p>") is None and read(">") == ({}, 1, False)


# a page grammar: what a page says is known as it is made


def made_page(r: random.Random) -> tuple[str, str]:
    words = [f"word{i}" for i in range(200)] + ["hidden", "menu", "a<b", "R&D", "naïve", "漢字"]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    def attributes():
        kinds = ["", ' class="post-title x"', " data-id=header", ' title="the hidden menu"', " data-x='a>b'", ' id="p1"', " itemprop=articleBody", ' class="no-sidebar"']
        return r.choice(kinds)

    def written(t):
        """The text with references and inline markup; white space varies."""
        out = []
        for w in t.split(" "):
            w = html.escape(w) if r.random() < 0.9 or "<" in w or "&" in w else w
            out.append(r.choice([w, w, w, f"<b>{w}</b>", f"<em{attributes()}>{w}</em>", f"{w}<!-- note -->"]))
        return r.choice([" ", "\n  ", "&#32;"]).join(out)

    def block(t):
        return f"<p{attributes()}>{written(t)}" + r.choice(["</p>", "</P >", "</p>\n"])

    paragraphs = [text(r.randrange(25, 80)) for _ in range(r.randrange(2, 7))]
    boilerplate = [
        lambda: f"<nav><ul><li><a href='/x'>{text(2)}</a><li><a href=/y>{text(1)}</a></ul></nav>", lambda: f'<div class="{r.choice(["ad", "ad-slot", "cookie-banner", "sidebar", "site-footer"])}">{text(9)}</div>',
        lambda: f"<aside>{text(12)}</aside>", lambda: f"<script>var x = '<p>{'y' * 20}</p>';</script>", lambda: f"<style>p > a {{ color: red }}</style><!-- {text(5)} > -->",
        lambda: f'<section id="comments"><p>{text(30)}</p><p>{text(8)}</p></section>', lambda: f"<form><input name=q><button>{text(1)}</button></form>",
        lambda: f"<footer>{text(10)}<a href='/z'>{text(2)}</a></footer>", lambda: f"<p hidden>{text(20)}</p>", lambda: f"<noscript>{text(6)}</noscript>",
    ]
    body = "".join(r.choice(boilerplate)() for _ in range(r.randrange(3)))
    inner = "".join(block(p) for p in paragraphs)
    holder = r.choice(["article", "main", 'div class="entry"', 'div class="widget"', 'div id="content"'])
    body += f"<{holder}>{inner}</{holder.split()[0]}>" + "".join(r.choice(boilerplate)() for _ in range(r.randrange(4)))
    return f"<!DOCTYPE html><html><head><title>{text(3)}</title></head><body>{body}</body></html>", " ".join(paragraphs)


def test_made_pages_are_read_as_they_were_made():
    r = random.Random(17)
    for _ in range(400):
        page, want = made_page(r)
        assert main_text(page) == want, page


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "text here", "".join(f"<div>word{i} " for i in range(20_000)), '<div class="widget">' * 20_000 + ART, "".join(f'<div class="a"><p>word {i} <a href=x>l</a></p>' for i in range(20_000)),
    "<p><span>" * 20_000, "</b>" * 20_000, "<select>" * 5_000 + '<a b="' * 5_000, "<a " * 50_000, "<a b='" * 20_000, "<article>" + "".join(f"<p>some words in paragraph {i}</p><nav>menu</nav>" for i in range(10_000)),
], ids=range(10))
def test_deep_and_broken_markup_takes_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 2
