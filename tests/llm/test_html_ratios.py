"""Pages on which the tag-path ratios decide: no article or main element, or a misleading one."""
import pathlib
import subprocess
import sys
import time

import pytest

from outline_ledger.llm import html_extract as H

WORDS = "river stone garden window letter winter market bridge engine forest".split()


def sentence(i, n=18):
    return " ".join(WORDS[(i * 7 + j * 3) % 10] + (", " if j % 6 == 5 else "") for j in range(n)).replace(" ,", ",").replace(",  ", ", ").strip(" ,") + "."


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


MENU = "<div class=x1><ul>" + "".join(f"<li><a href=/{i}>section number {i} of the long directory</a></li>" for i in range(60)) + "</ul></div>"
LABELS = "<div class=x3><table>" + "".join(f"<tr><td>label {i}</td><td>value {i}</td></tr>" for i in range(80)) + "</table></div>"
PARAS = [sentence(i) for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)
CARDS = "".join(f"<article><a href=/c{i}>Card {i}</a></article>" for i in range(12))

CASES = {
    "menu before": MENU + f"<div class=x2>{BODY}</div>",
    "labels after": f"<div class=x2>{BODY}</div>" + LABELS,
    "both": MENU + f"<div class=x2>{BODY}</div>" + LABELS,
    "misleading articles": CARDS + f"<div class=x2>{BODY}</div>" + CARDS,
}


@pytest.mark.parametrize("name", CASES)
def test_ratios_find_the_text(name):
    assert H.main_text(page(CASES[name])) == " ".join(PARAS)


def test_without_the_ratios_the_text_is_not_found(monkeypatch):
    monkeypatch.setattr(H, "path_weights", lambda blocks, smooth=1.0: (dict.fromkeys((b[0] for b in blocks), 1.0), 1.0))
    wrong = [n for n in CASES if H.main_text(page(CASES[n])) != " ".join(PARAS)]
    assert wrong == list(CASES)


def test_headings_and_short_blocks_of_the_container_stay():
    inner = f"<h2>Part</h2>{BODY}<p>Short one</p><ul><li><a href=/x>linked source</a></li></ul><p>{PARAS[0]}</p>"
    want = f"Title Part {' '.join(PARAS)} Short one linked source {PARAS[0]}"
    assert H.main_text(page(MENU + f"<h1>Title</h1><div class=x2>{inner}</div>" + LABELS)) == want


def test_nothing_goes_inside_an_article():
    odd = ('<ul class=refs><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><div class="alert">Mind this.</div>'
           '<pre class="skip-line">code line</pre><div class="share-price">12.5</div>')
    want = f"T {PARAS[0]} One Two Mind this. code line 12.5"
    assert H.main_text(page(f"<nav>menu</nav><article><h1>T</h1><p>{PARAS[0]}</p>{odd}</article><footer>f</footer>")) == want
    parts = '<div class="ad">Buy, now.</div><section class="comments"><p>No.</p></section><form><p>Send.</p></form>'
    assert H.main_text(page(f"<article><h1>T</h1><p>{PARAS[0]}</p>{parts}</article>")) == f"T {PARAS[0]}"


def test_advert_of_a_page_with_an_empty_article_is_no_text():
    assert H.main_text(page('<div class="ad">Buy this, now.</div><article></article>')) == ""


def test_hidden_words_inside_a_block():
    assert H.main_text(f"<article><p>{PARAS[0]} a<span hidden>b</span>c</p></article>") == f"{PARAS[0]} ac"


def test_unclosed_elements():
    for tag in ("iframe", "svg", "template"):
        assert H.main_text(page(f"<article><{tag}><p>{PARAS[0]}</p></article>")) == PARAS[0]
    assert H.main_text(f"<p>{PARAS[0]}</p><script>rest <p>of the page") == PARAS[0]


@pytest.mark.parametrize("deep", ["<div>", "<div class=c>", "<b>", "<svg>", "</p>", "<p><b>", "<a>", "<nav>"])
def test_time_grows_with_the_page(deep):
    start = time.process_time()
    assert PARAS[0] in H.main_text(deep * 30_000 + f"<article><p>{PARAS[0]}</p></article>")
    assert time.process_time() - start < 10


def test_memory_of_a_deep_page():
    code = ("import resource; from outline_ledger.llm.html_extract import main_text\n"
            "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "assert main_text('<div>' * 100_000 + '<p>Words, at last.') == 'Words, at last.'\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2])
    assert int(out.stdout) < 300
