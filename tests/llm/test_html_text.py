import random
import time

import pytest

from tokenmill.llm import html_text
from tokenmill.llm.html_text import extract, lines, main_text, surges, weights

LONG = "This is a paragraph of the article that goes on for quite some time and has well over eighty characters."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        (f"<nav><a>x</a></nav><article><h1>A &amp; B</h1><p>{LONG}<p> two\n  words <br>and&nbsp;more</article><footer>&copy; x</footer>", f"A & B\n{LONG}\ntwo words and more"),
        (f"<script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div><p>{LONG}</p><p>Short.</p></div>", f"{LONG}\nShort."),
        (f"<main><p>{LONG}</p><div class='ad'>Buy</div><aside>Side</aside><form>F<input></form><p>End</p><section id=comments><p>{LONG}</p></section></main>", f"{LONG}\nEnd"),
        (f"<header><p>{LONG}</p></header><div class='content with-sidebar'><p>{LONG}</p></div><div id='sidebar'>{LONG}</div><div class='cookie-notice'>{LONG}</div>", LONG),
        (f"<ul><li><a href=1>{LONG}</a><li><a href=2>{LONG}</a></ul><p>{LONG}</p>", LONG),
        (f"<article><p>{LONG}", LONG),
        (f"<article><p title=it's>{LONG}</p><p title='a > b' lang=\"x\">{LONG}</p>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><p data-x='>{LONG}", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p> <b class='>'", f"{LONG}\n'"),
        ("<article><p>a < b & c &lt;d&gt; &#233; &#x41; &bogus;</article>", "a < b & c <d> é A &bogus;"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_query_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}é</article>", 5), (1, "u", f"<article><p>{LONG}é</article>", 5), (None, None, None, None), (2, "v", "x" * 300_000, 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(LONG) + 1)] * 2 + [(None, 0), (2, 300_000)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def slow_text(page, window, surge):
    """main_text by its definition, one window at a time."""
    found = [(x.text(), x) for x in lines(page) if x.text() and not (x.off and x.main)]
    weight = weights(found)

    def mass(i):
        total = 0
        for j in range(i, min(i + window, len(found))):
            if found[j][1].main != found[i][1].main:
                break
            total += weight[j]
        return total

    keep, i = [], 0
    while i < len(found):
        if not weight[i] or mass(i) <= surge:
            i += 1
            continue
        main = found[i][1].main
        while i < len(found) and found[i][1].main == main and mass(i) > 0:
            if weight[i]:
                keep.append(found[i][0])
            i += 1
    return "\n".join(keep or [t for (t, _), w in zip(found, weight) if w])


@pytest.mark.parametrize("seed", range(4))
def test_matches_windows_one_by_one(seed):
    r = random.Random(seed)
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 25)):
            text = "x" * r.choice([1, 5, 30, 70, 100, 400])
            parts.append(r.choice(["<p>{}</p>", "<div class=ad>{}</div>", "<p><a>{}</a> y</p>", "<article><p>{}", "</article>{}", "<aside>{}</aside>", "<main>{}</main>", "{}<br>"]).format(text))
        page, window, surge = "".join(parts), r.randint(1, 5), r.choice([0, 40, 80, 300])
        assert main_text(page, window, surge) == slow_text(page, window, surge)


def test_the_window_decides():
    """Lines far from text stay out, next to text they don't; marked content or not."""
    short, menu = "<p>Top ten.</p>", "<nav>a</nav>" * 4
    assert main_text(f"{short}{menu}<p>{LONG}</p><p>End.</p>{menu}{short}") == f"{LONG}\nEnd."
    assert main_text(f"{short}<p>{LONG}</p>{menu}{short}") == f"Top ten.\n{LONG}"
    assert main_text(f"{short}{menu}<p>{LONG}</p>", window=6) == f"Top ten.\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p>{menu}{short}</article>{short}") == f"{LONG}\nTop ten."
    assert main_text(f"<main><p>Wait ...</p></main>{menu}<div>{LONG * 4}</div>") == LONG * 4
    assert main_text(f"<main><p>Wait ...</p><p>Now.</p></main>{menu}<div>{LONG}</div>") == "Wait ...\nNow."
    assert main_text(f"<p>{LONG}</p><article><p>{LONG}</p><p>End.</p></article>") == f"{LONG}\nEnd."
    assert main_text(f"<p>{LONG * 4}</p><article><p>{LONG}</p><p>End.</p></article>") == f"{LONG * 4}\n{LONG}\nEnd."
    assert surges([0, 5, 0, 0, 90, 0, 0, 0], [False] * 8, 3, 80) == [False, False, False, False, True, False, False, False]


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<a '>' ", "<p class='", '<a x="<', "</script ", "<script", "<!", "<a class=\"", "<li><p>", "</b", "&", "< ", "<a = = ", "<b>x"])
def test_a_million_characters_of_markup_take_a_moment(piece):
    began = time.process_time()
    main_text(piece * (1_000_000 // len(piece)))
    main_text(piece * (1_000_000 // len(piece)) + "'>\">")
    assert time.process_time() - began < 8
