"""Templates decide where tags don't: opaque pages, hosts of copies, deep and wide trees."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from lapreplay.llm import html_text

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()


def text_of(k, n=60):
    return " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] + str((k * 31 + i) % 97) for i in range(n)) + "."


def opaque(k):
    """A page without one telling tag or name, and its main text."""
    rows = [text_of(k * 50 + i) for i in range(2 + k % 4)]
    body = f"<h1>{text_of(k, 5)}</h1>" + "".join(f"<p>{r}</p>" for r in rows[:-1]) + f"<div><p>Share this page</p></div><p>{rows[-1]}</p>"
    links = "".join(f"<div><a href='/{i}'>{text_of(k + i, 2)}</a></div>" for i in range(8))
    page = f"<html><body><div>The Daily Example</div><div>{links}</div><div>{text_of(k + 9, 6)}</div><div>{body}</div><div>{links}</div><div>Imprint {text_of(k, 3)}</div></body></html>"
    return page, "\n".join([text_of(k, 5), *rows])


def template_of(pages):
    whole = None
    for p in pages:
        s = html_text.shape(html_text.parse(p))
        whole = html_text.merge(whole, s) if whole else s
    return html_text.placed(whole)


def test_opaque_pages():
    pages = [opaque(k) for k in range(12)]
    template = template_of([p for p, _ in pages])
    for page, want in pages:
        assert html_text.extract(page, template) == want
        assert html_text.extract(page, None) != want  # the template decides


def test_one_opaque_page():
    page, want = opaque(3)
    got = html_text.extract(page, template_of([page]))
    assert got.replace("Share this page\n", "") == want  # no other page tells that this is furniture


def test_real_pages_without_their_tags():
    """The shared pages with article, nav and footer turned to div, and no class."""
    hosts, same, every = {}, 0, 0
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        hosts.setdefault(re.search(r"//([^/]+)", r["url"])[1], []).append(r["html"])
    for pages in hosts.values():
        if len(pages) < 4:
            continue
        bare = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", p)) for p in pages]
        template = template_of(bare)
        for p, b in zip(pages, bare, strict=True):
            every += 1
            same += html_text.extract(b, template) == html_text.extract(p, None)
    assert every > 100 and same >= 0.95 * every


def test_host_of_copies():
    page, want = opaque(1)
    template = template_of([page] * 20)
    assert html_text.extract(page, template).replace("Share this page\n", "") == want


@pytest.mark.parametrize("tag", ["div", "ul", "p", "table", "header", "a", "span"])
def test_deep_pages(tag):
    page = "<body><article>" + f"<{tag}>x" * 10_000 + f"</{tag}>" * 10_000 + "</article></body>"
    began = time.time()
    template = template_of([page, page.replace("x", "y")])
    assert html_text.extract(page, template).replace("\n", "") == "x" * 10_000
    assert time.time() - began < 30


def test_wide_pages():
    page = "<body><article>" + "".join(f"<p>a{i}</p><div>b{i}</div><ul><li>c{i}</ul>" for i in range(4_000)) + "</article></body>"
    began = time.time()
    template = template_of([page, page.replace("a", "q"), page])
    assert len(html_text.extract(page, template).split("\n")) == 12_000
    assert time.time() - began < 60


def test_templates_stay_small():
    whole = None
    for k in range(300):
        page = "<body>" + "".join(f"<div class='c{k}x{i}'><p>t</p></div>" for i in range(20)) + "<div><p>Always</p></div></body>"
        s = html_text.shape(html_text.parse(page))
        whole = html_text.pruned(html_text.merge(whole, s)) if whole else s
    assert sum(1 for _ in html_text.nodes(whole)) <= html_text.NODES
    assert any(html_text.constant(n) for n in html_text.nodes(whole))


@pytest.mark.parametrize("text", ["", "\0", "<", "<<<>>>", "<a", "&#x110000;&#0;&nbsp;", "<p>" * 5_000, "</p>" * 5_000, "<table><td>a<td>b<tr>c", "a" * 300_000, "<article><article>x</article></article>", "<!--" * 1_000])
def test_broken_markup(text):
    got = html_text.extract(text, template_of([text]))
    assert got == "\n".join(" ".join(x.split()) for x in got.split("\n")) and html.unescape(got) is not None


def test_what_an_article_keeps():
    """Headings that all pages have, and sections named like furniture, are part of an article; comments and adverts in it aren't."""
    pages = [f"<html><body><nav><a href=x>Home</a></nav><article><h1>T {i}</h1><p>text {i} one</p><h2>Summary</h2><p>end {i}</p><div>Subscribe now</div></article></body></html>" for i in range(10)]
    template = template_of(pages)
    assert html_text.extract(pages[3], template) == "T 3\ntext 3 one\nSummary\nend 3"
    page = (
        "<html><body><article><h1>T</h1><section id='discussion'><p>deep</p></section><h2 id='related-work'>Rel</h2><p class='login-steps'>steps</p><div class='comments'><p>c</p></div>"
        "<div id='comments'>x</div><p class='ad'>buy</p><div class='sidebar-box'>y</div><p>end <math><mi>x</mi></math></p></article></body></html>"
    )
    assert html_text.extract(page, None) == "T\ndeep\nRel\nsteps\nend x"


def test_templates_decide_on_the_shared_pages():
    """Each page's main part is where its host's template has it; without templates the pages of one host lose nothing they share."""
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    hosts = {}
    for r in rows:
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    for pages in hosts.values():
        template = template_of(pages)
        for page in pages:
            root = html_text.parse(page)
            parts = html_text.main_parts(root, template)
            assert parts and "\n".join(html_text.lines(root, template, {id(p) for p in parts})) == html_text.extract(page, template)
