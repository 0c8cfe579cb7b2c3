import pytest

from graphloom.llm import html_text


@pytest.mark.parametrize("around", [4, 10, 20, 40])
def test_lines_outside_paragraphs_stay(around):
    line = lambda k: f"line {k} ".ljust(39, "x") + "y"
    paragraphs = "".join(f"<p>{'word, ' * 83}{k:02}</p>" for k in range(around))
    lines = "".join(f"<div>{line(k)}</div>" for k in range(4))
    linked = '<div><a href="/">a linked word</a></div>'
    text = html_text.main_text(f"<body><nav>menu</nav><article>{paragraphs}{lines}{linked}<div class='share'>share this</div></article></body>")
    assert all(line(k) in text for k in range(4)) and "a linked word" in text
    assert "menu" not in text and "share this" not in text
