"""Long attribute values and deep nesting."""

import time

import pytest

from fleetlint.llm import html


def test_long_quoted_value_is_no_text():
    items = html.Items('<div data-x="' + "<p>not text</p>" * 600 + '">words</div>').items
    assert [t for _, t, _ in items if t] == ["words"]


def test_deep_nesting_keeps_containers():
    items = html.Items("<main>" + "<div>" * 300 + "deep" + "</div>" * 300 + "after</main>").items
    after = next(s for _, t, s in items if t == "after")
    assert after.kind == "main" and after.outer is None


def test_deep_unclosed_pages_stay_linear():
    began = time.time()
    page = "<article>words " + "<div class=a>x" * 100_000 + "</ul></div>" * 100_000
    assert html.extract(page, html.Weights({})).startswith("words")
    assert html.Items('<a x="' * 20_000).items
    assert time.time() - began < 30


def main_text(inner):
    """Without learned weights: what structure and names alone tell."""
    return html.extract(f"<body><nav>menu</nav><article><h1>Title</h1>{inner}</article><footer>foot</footer></body>", html.Weights({}))


@pytest.mark.parametrize("inner,want", [
    ("<p>one</p><svg-icon name=x></svg-icon><p>two</p>", "one two"),
    ("<p>one</p><svg class=i /><p>two</p>", "one two"),
    ("<p>one</p><svg><text>drawn</text></svg><p>two</p>", "one two"),
    ("<p>one</p><select-box>q</select-box><p>two</p>", "one q two"),
    ("<p>one</p><select><option>x</option><p>two</p>", "one x two"),
    ("<p>one</p><title/><p>two</p>", "one two"),
    ("<p>one</p><p class=\"advert\">buy</p><p>two</p>", "one two"),
    ("<p>one<p class=advert>buy<p>two", "one two"),
    ("<p>one <ins class=\"adsbygoogle\">buy</ins> more</p>", "one more"),
    ("<p>one</p><blockquote class='comment'>said <blockquote>inner</blockquote> so</blockquote><p>two</p>", "one two"),
    ("<p>one</p><dl class=\"box related\"><dt>a<dd>b</dl><p>two</p>", "one two"),
    ("<p>one <span id=x-ad>a <span>b</span> c</span> two</p>", "one two"),
    ("<p>one <span class=ad>a</p><p>two</p>", "one two"),
    ("<ul><li>one<li class=sponsored>buy<li>two</ul>", "one two"),
    ("<ad-slot>buy</ad-slot><p>one</p>", "one"),
    ("<p>one</p><div role=alert>notice</div><p data-class=ad>two</p>", "one two"),
])
def test_any_named_element_is_a_container(inner, want):
    assert main_text(inner) == "Title " + want


def test_unclosed_hidden_elements_stay_linear():
    page = "<article>words " + "<select>x " * 50_000 + "<svg>y " * 50_000
    assert len(html.Items(page).items) > 100_000
    assert html.extract("<article>a <template>b</article>", html.Weights({})) == "a b"
