import pytest

from outline_ledger.llm.html_extract import main_text

TEXT = "A long paragraph of the page, with words enough, and marks; so it is content."


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "layout-with-nav", "page-header-fixed"])
def test_wrapper_named_after_a_part(name):
    page = f'<html><body><div class="{name}"><p>{TEXT}</p><p>{TEXT}</p></div></body></html>'
    assert main_text(page) == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("name", ["article-header", "entry-header"])
def test_heading_in_the_header_of_an_article(name):
    page = f'<html><body><article><div class="{name}"><h1>Title</h1></div><p>{TEXT}</p></article></body></html>'
    assert main_text(page) == f"Title {TEXT}"


def test_parts_by_name_stay_out():
    page = f'<html><body><div class="site-sidebar"><p>Other words.</p></div><div><p>{TEXT}</p></div></body></html>'
    assert main_text(page) == TEXT
