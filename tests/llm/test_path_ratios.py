import re

import numpy as np
import pytest

from graphloom.llm import html_text


def paragraphs(n, first=0):
    return "".join(f"<p>Paragraph {k}, with words enough to be running text. It goes on, and on.</p>" for k in range(first, first + n))


TWELVE = html_text.main_text(paragraphs(12))


def test_lists_of_links_lose_without_any_hint():
    links = "".join(f"<a href='x'>Link {k}</a> " for k in range(20))
    items = "".join(f"<div><a href='x'>Link {k}</a></div>" for k in range(20))
    for menu in (links, items):
        assert html_text.main_text(f"<body><div>{menu}</div><div>{paragraphs(12)}</div></body>") == TWELVE
        assert html_text.main_text(f"<body><div>{paragraphs(12)}</div><div>{menu}</div></body>") == TWELVE
    cells = f"<table><tr><td><ul><li><a>Home</a></li><li><a>About</a></li></ul></td><td><h1>Title</h1>{paragraphs(12)}</td></tr></table>"
    assert html_text.main_text(f"<body>{cells}</body>") == f"Title {TWELVE}"


def test_article_text_is_not_lost_to_words_in_names():
    page = f"<body><article><section id='comment-theory'>{paragraphs(6)}</section><div class='side-effects'>{paragraphs(6, 6)}</div><p>Ok</p></article>"
    assert html_text.main_text(page + f"<div id='comments'>{paragraphs(40)}</div></body>") == f"{TWELVE} Ok"
    inside = "<div class='cookie-notice'>We use cookies.</div><div class='ad-slot top'>Buy.</div><ul class='related-posts'><li><a>x</a></li></ul>"
    assert html_text.main_text(f"<body><article>{paragraphs(12)}{inside}</article></body>") == TWELVE


def test_headings_sections_and_short_blocks_of_the_content_stay():
    page = f"<body><h1>Title</h1><div class='content'>{paragraphs(12)}<ul><li>one</li><li>two</li></ul></div><div class='box'>Buy now</div></body>"
    assert html_text.main_text(page) == f"Title {TWELVE} one two"
    sections = f"<main><section><h2>A</h2>{paragraphs(1)}</section><section><h2>B</h2>{paragraphs(6)}</section></main>"
    assert html_text.main_text(sections).startswith("A Paragraph 0")
    assert html_text.main_text("<article><p><a href='x'>All of it is a link</a></p></article>") == "All of it is a link"


def bare(page):
    """The page without what its tags and classes say."""
    return re.sub(r"(</?)(article|nav|footer)\b", r"\1div", page).replace(' class="ad"', "")


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_the_ratios_alone_find_the_article(spark, sf, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect() if r.html]
    texts = [html_text.main_text(p) for p in pages]
    found = [html_text.main_text(bare(p)) for p in pages]
    assert sum(a == b for a, b in zip(texts, found, strict=True)) >= 0.9 * len(pages)
    rng = np.random.default_rng(5)
    monkeypatch.setattr(html_text, "path_ratios", lambda nodes: rng.random(len(nodes)))
    assert sum(html_text.main_text(bare(p)) == t for p, t in zip(pages, texts, strict=True)) < 0.5 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "path_scores", lambda nodes: 2 * rng.random(len(nodes)))
    assert sum(html_text.main_text(p) == t for p, t in zip(pages, texts, strict=True)) < 0.2 * len(pages)
