"""Main text of pages whose names, titles and depth mislead."""

import time

import pytest

from changeimpact.llm import html_text

BODY = "<p>Body text, long enough to count, of an article.</p>"
TEXT = "Body text, long enough to count, of an article."
PROBES = {
    f"<div class='layout has-sidebar'>{BODY}</div>": TEXT,
    f"<div id='page' class='page with-sidebar'><article>{BODY}</article></div>": TEXT,
    f"<form id='aspnetForm'><div>{BODY}</div></form>": TEXT,
    f"<form class='newsletter-form'><article>{BODY}</article></form>": TEXT,
    f"<article>{BODY}<section id='related-work'><p>Work that is related.</p></section><p class='share-price'>Up by two.</p></article>":
        TEXT + "\nWork that is related.\nUp by two.",
    f"<main><h1>Title</h1><article>{BODY}</article></main>": "Title\n" + TEXT,
    f"<main><p>Intro</p><article>{BODY}</article></main>": "Intro\n" + TEXT,
    f"<h1>Title</h1><article>{BODY}</article><p><a href=x>more</a></p>": "Title\n" + TEXT,
    f"<article>{BODY}<p>Press <button>OK</button> to go on</p><button>Subscribe</button></article>": TEXT + "\nPress OK to go on",
    f"<article>{BODY}<div class='cookie-notice'>We use cookies</div><div class='share-buttons'>Send</div></article>": TEXT,
    f"<article>{BODY * 8}</article><div id='comments'>{'<p>Nice post, I think, thanks.</p>' * 90}</div>": "\n".join([TEXT] * 8),
    f"<div class='content'>{BODY * 8}</div><div class='comment-list'>{'<p>Nice post, I think, thanks.</p>' * 90}</div>": "\n".join([TEXT] * 8),
}


@pytest.mark.parametrize("page", PROBES)
def test_names_only_mark_small_blocks(page):
    assert html_text.main_text(f"<body>{page}</body>") == PROBES[page]


@pytest.mark.parametrize("start, more", [("", "<div>"), ("<div>", "<i></b>"), ("<p><object>", "<div>"), ("<ul>", "<li>a")])
def test_work_is_linear_in_depth(start, more):
    def seconds(n):
        begun = time.process_time()
        html_text.main_text(start + more * n + "text")
        return time.process_time() - begun

    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)
