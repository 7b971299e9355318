"""Pages whose main part carries names of states or side parts."""

from __future__ import annotations

import pytest

from grainspark.llm import htmlmain

PROSE = "<p>" + "A long sentence, with commas, that reads like the prose of an article and goes on. " * 4 + "</p>"


@pytest.mark.parametrize("tag", ["main class='content has-sidebar'", "div id='wrapper' class='no-sidebar'", "article class='post comments-open'", "div class='page nav-open'", "div class='content sidebar-right'", "div class='sidebar'"])
def test_names_of_states_do_not_cut_the_text(tag):
    html = f"<body><nav><a href=x>Home</a></nav><{tag}>{PROSE}</{tag.split()[0]}></body>"
    assert "reads like the prose" in " ".join(htmlmain.main_blocks(html))


def test_side_parts_still_go():
    side = PROSE.replace("prose", "sidebar")
    html = f"<body><div class='post'>{PROSE}</div><div class='sidebar'>{side}</div><div class='comment-body'>{side}</div></body>"
    assert "of the sidebar" not in " ".join(htmlmain.main_blocks(html)) and htmlmain.main_blocks(html)


def test_short_sections_and_headings_before_the_best_part():
    html = f"<body><div><h1>The title</h1><div>{PROSE}</div><h2>More</h2><div><p>A short section, of one line only.</p></div></div></body>"
    assert htmlmain.main_blocks(html)[0] == "The title" and "A short section, of one line only." in htmlmain.main_blocks(html) and "More" in htmlmain.main_blocks(html)


def test_a_header_deep_inside_an_article_stays():
    html = "<article>" + "<div>" * 14 + "<header><h1>The title</h1></header>" + PROSE + "</div>" * 14 + "</article><header><h1>Site</h1></header>"
    assert htmlmain.main_blocks(html)[0] == "The title" and "Site" not in htmlmain.main_blocks(html)


@pytest.mark.parametrize("tag", ["article", "main", "div class='entry-content'"])
def test_references_stay_and_menus_go(tag):
    links = "<ul>" + "".join(f"<li><a href=x>Reference number {k}</a></li>" for k in range(5)) + "</ul>"
    html = f"<body>{links.replace('Reference', 'Menu')}<{tag}>{PROSE}<h2>References</h2>{links}</{tag.split()[0]}></body>"
    found = htmlmain.main_blocks(html)
    assert found[-6:] == ["References", *(f"Reference number {k}" for k in range(5))] and not any("Menu" in x for x in found)


def test_formulas_stay_in_their_block():
    assert "where x equals y holds" in " ".join(htmlmain.main_blocks(f"<article>{PROSE}<p>where <math><mi>x</mi> equals <mi>y</mi></math> holds</p></article>"))


def test_pages_without_article_elements(sf_dir):
    import re

    import duckdb

    for (html,) in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet'").fetchall():
        assert htmlmain.main_blocks(re.sub(r"(</?)(article|main)\b", r"\1div", html)) == htmlmain.main_blocks(html)


ASIDE = "<p>" + "A reader writes something, as readers do, and it is no part of the text. " * 3 + "</p>"


@pytest.mark.parametrize("part", [
    "<div class='comment text'>{}</div>", "<section class='comments post'>{}</section>", "<ul class='menu main'><li>Home</li><li>About us, a reader writes</li></ul>",
    "<div class='is-sponsored'>{}</div>", "<div class='entry comment-list'>{}</div>", "<div class='post sidebar-left'>{}</div>", "<div id='respond' class='content'>{}</div>",
])
@pytest.mark.parametrize("page", ["<article>{0}{1}</article>", "<body><div class='content'>{0}{1}</div></body>", "<body><main><div>{0}</div>{1}</main></body>", "<body><table><tr><td>{0}{1}</td></tr></table></body>"])
def test_side_parts_that_also_name_content_go(part, page):
    found = " ".join(htmlmain.main_blocks(page.format(PROSE, part.format(ASIDE))))
    assert "reads like the prose" in found and "reader writes" not in found and "Home" not in found


@pytest.mark.parametrize("html", [
    "<body><div class='sidebar'><p>Recent posts, and links.</p></div></body>", "<body><div class='cookie-notice'>" + ASIDE + "</div></body>", "<body><div class='comments'>" + ASIDE * 3 + "</div></body>",
    "<body><div class='advert'>" + PROSE + "</div><div id='sidebar'>Archive</div></body>", "<body><ul class='menu'><li>" + ASIDE + "</li></ul></body>",
])
def test_pages_of_side_parts_alone_are_empty(html):
    assert htmlmain.main_blocks(html) == []


@pytest.mark.parametrize("tag", ["div class='content sidebar-right'", "div class='main-wrap sidebar-layout content'", "main class='comment-page'", "article class='post nav-style'"])
def test_the_part_with_the_prose_stays_in_doubt(tag):
    html = f"<body><div class='intro'><p>Short words.</p></div><{tag}>{PROSE}<div class='comment'>{ASIDE}</div></{tag.split()[0]}></body>"
    found = " ".join(htmlmain.main_blocks(html))
    assert "reads like the prose" in found and "reader writes" not in found
