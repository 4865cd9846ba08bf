"""Only what a page really hides is dropped."""

import pytest

from lapreplay.llm import html_text

PAGE = "<html><body><div><article><p>First.</p><{}>Second.</{}></article></div></body></html>"


@pytest.mark.parametrize("attributes", ['class="overflow-hidden"', 'aria-hidden="false"', 'title="The hidden cost"', "data-x='display:none'", 'class="a" data-hidden="1"', 'style="overflow:hidden"', 'title="a=b hidden c"'])
def test_words_in_attributes(attributes):
    for tag in ("html", "body", "div", "article", "p"):
        page = PAGE.format("p", "p").replace(f"<{tag}>", f"<{tag} {attributes}>")
        assert html_text.extract(page, None) == "First.\nSecond."


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "class=x HIDDEN", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"', "style='display:none !important'"])
def test_hidden_parts(attributes):
    assert html_text.extract(PAGE.format(f"div {attributes}", "div"), None) == "First."
    for tag in ("html", "body", "article"):  # never the page itself
        page = PAGE.format("div", "div").replace(f"<{tag}>", f"<{tag} {attributes}>")
        assert html_text.extract(page, None) == "First.\nSecond."
