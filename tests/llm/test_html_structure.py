"""Boilerplate that no list of names tells: boxes apart from the article's, and blocks of links."""

import re

import pytest

from framelake.llm import html_text

TITLE = "<h1>The long road home</h1>"
PARAGRAPHS = [
    "<p>The road was long and the travellers were tired after many days on it.</p>",
    "<p>They met others who had a story to tell, and told it well into the night.</p>",
    "<p>In the end all of them came home again.</p>",
]
ARTICLE = TITLE + "".join(PARAGRAPHS)
WANT = "\n".join(re.findall(r"<(?:h1|p)>(.*?)</", ARTICLE))
BOILERPLATE = {
    "comments": '<div id="disqus_thread"><p>Great piece, thanks for it!</p><p>I disagree with all of this.</p></div>',
    "footer": '<div class="site-bottom"><p>Copyright 2024 Example Media, all rights are reserved</p></div>',
    "feedback": '<div class="user-feedback"><p>Was this page helpful to you? Tell us.</p></div>',
    "offer": '<div class="cta-box"><h3>Join today</h3><p>Get the best offers in your inbox every week.</p></div>',
    "menu": '<table><tr><td><a href="/n">News</a></td><td><a href="/s">Sport</a></td></tr></table>',
    "named by its last word": '<div class="site-footer"><p>All rights reserved here</p></div>',
    "named by its first word": '<section class="comments-list"><p>Nice one</p></section>',
}


@pytest.fixture(scope="module")
def weights():
    return html_text.learn_weights()


@pytest.mark.parametrize("kind", BOILERPLATE)
@pytest.mark.parametrize("wrap", ["%s", "<div>%s</div>", '<div class="zz">%s</div>', '<div id="content">%s</div>', '<div class="page-wrap"><div class="story">%s</div></div>', "<article>%s</article>"])
def test_unknown_boilerplate_leaves(weights, kind, wrap):
    other = BOILERPLATE[kind]
    pages = [wrap % ARTICLE + other, other + wrap % ARTICLE]
    if wrap != "<article>%s</article>":  # inside an article an unknown name tells nothing
        pages.append(wrap % (ARTICLE + other))
    for page in pages:
        assert html_text.main_text(f"<html><body>{page}</body></html>", weights) == WANT


def test_all_at_once(weights):
    page = BOILERPLATE["menu"] + ARTICLE + "".join(BOILERPLATE.values())
    assert html_text.main_text(f"<body>{page}</body>", weights) == WANT


@pytest.mark.parametrize(
    "page",
    [
        TITLE + "".join(f'<div class="para">{p}</div>' for p in PARAGRAPHS),
        TITLE + "".join(f'<div id="b{i}">{p}</div>' for i, p in enumerate(PARAGRAPHS)) + BOILERPLATE["footer"],
        TITLE + f'<div id="wrapx">{"".join(PARAGRAPHS)}</div>',
        TITLE + "".join(f'<div id="{name}">{p}</div>' for name, p in zip(("history", "people", "end"), PARAGRAPHS)),
        f'<div class="zz"><h1><a href="/x">{TITLE[4:-5]}</a></h1>{"".join(PARAGRAPHS)}</div>',
        f'<div class="has-sidebar">{ARTICLE}</div>',
        f'<div class="zz">{TITLE}<div class="intro">{PARAGRAPHS[0]}</div>{"".join(PARAGRAPHS[1:])}</div>',
    ],
    ids=["one class", "numbered", "box beside the heading", "a name each", "linked heading", "negated", "name tells content"],
)
def test_boxes_of_the_article_stay(weights, page):
    assert html_text.main_text(f"<body>{page}</body>", weights) == WANT


def test_links_after_a_heading_do_not_cut_it_off(weights):
    links = "".join(f'<li><a href="/{i}">part {i} of it</a></li>' for i in range(8))
    assert html_text.main_text(f"<body><article>{TITLE}<ul>{links}</ul>{''.join(PARAGRAPHS)}</article></body>", weights) == WANT


def test_more_apart_than_the_rest_is_kept(weights):
    thread = '<div id="zz">' + "<p>I have another thought on all of that, which is this one.</p>" * 9 + "</div>"
    assert html_text.main_text(f"<body>{ARTICLE}{thread}</body>", weights).startswith(WANT)


def test_boxes_are_linear_in_depth(weights):
    deep = '<div class="q">' * 20_000 + "<p>word and word</p>" + "</div>" * 20_000
    assert html_text.main_text(f"<body>{deep}</body>", weights) == "word and word"
    unclosed = "".join(f'<div class="q{i} {"x" * (i % 50)}">a ' for i in range(20_000))
    html_text.main_text(unclosed, weights)
    assert html_text.main_text('<div class="q"></div>', weights) == html_text.main_text("", weights) == ""
