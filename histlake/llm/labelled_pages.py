"""Labelled pages from which the weights of HTML extraction are learned.

Each page is a list of (words are content?, markup) parts, put together from parts of common layouts (weblogs, news,
manuals, shops, forums) by a fixed sequence of choices. The words are filler, since only tags, what boxes go by, and
the number of words count.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

PAGES = 60


def filler(n: int) -> str:
    return " ".join(f"w{i}" for i in range(n))


def links(n: int, words: int = 1) -> str:
    return "".join(f'<li><a href="/{i}">{filler(words)}</a></li>' for i in range(n))


def inline(r: random.Random, n: int) -> str:
    """A paragraph's words, now and then linked or set off."""
    out = []
    while n > 0:
        k = min(n, r.randrange(4, 25))
        how = r.random()
        out.append(f'<a href="/x">{filler(min(k, 3))}</a>' if how < 0.12 else f"<em>{filler(k)}</em>" if how < 0.2 else filler(k))
        n -= k
    return " ".join(out)


def body(r: random.Random, least: int = 2) -> str:
    """The content of a page."""

    def one() -> str:
        n = r.randrange(8, 70)
        return r.choice(
            [
                f"<p>{inline(r, n)}</p>", f"<p>{inline(r, n)}</p>", f"<p>{inline(r, n)}</p>", f"<p>{inline(r, n)}", f"<div>{inline(r, n)}</div>", f"<h2>{filler(n // 8)}</h2><p>{inline(r, n)}</p>",
                f"<blockquote>{inline(r, n)}</blockquote>", f"<ul><li>{inline(r, n // 3)}</li><li>{inline(r, n // 3)}</li></ul>", f"{inline(r, n)}<br>{inline(r, n)}<br><br>", f"<pre>{filler(n // 2)}</pre>",
                f"<table><tr><td>{filler(n // 4)}</td><td>{filler(n // 4)}</td></tr></table>", f'<figure><img src="i"><figcaption>{filler(n // 5)}</figcaption></figure>',
            ]
        )

    return f"<h1>{filler(r.randrange(3, 10))}</h1>" + "".join(one() for _ in range(r.randrange(least, 2 * least + 5)))


def before(r: random.Random) -> str:
    """What stands above content."""
    parts = [
        f"<header><h2>{filler(3)}</h2><a href='/'>{filler(1)}</a></header>", f'<div class="site-header">{filler(4)}</div>', f"<nav><ul>{links(r.randrange(3, 9))}</ul></nav>",
        f'<div id="menu">{" ".join(f"<a href=#>{filler(1)}</a>" for _ in range(r.randrange(3, 8)))}</div>', f'<ul class="breadcrumbs">{links(3)}</ul>', f'<div class="cookie-notice"><p>{filler(14)}</p><button>{filler(1)}</button></div>',
        f'<div class="top-banner">{filler(7)}</div>', f'<form class="search"><input><button>{filler(1)}</button></form>', f'<div class="advert">{filler(r.randrange(3, 14))}</div>', f'<aside class="left-sidebar"><h3>{filler(2)}</h3><ul>{links(5, 3)}</ul></aside>',
        f'<table><tr><td><a href="/">{filler(1)}</a></td><td><a href="/">{filler(2)}</a></td></tr></table>', "<script>if (a<b) { c('</p>') }</script>", "<style>p > a {margin: 0}</style>",
    ]
    return "".join(r.sample(parts, r.randrange(2, 6)))


def after(r: random.Random) -> str:
    """What stands below content."""
    talk = "".join(f'<div class="comment"><p>{filler(r.randrange(4, 25))}</p></div>' for _ in range(r.randrange(1, 6)))
    parts = [
        f"<footer><p>{filler(8)}</p><ul>{links(4)}</ul></footer>", f'<div class="footer">{filler(9)} <a href="#">{filler(2)}</a></div>', f'<section id="comments"><h3>{filler(2)}</h3>{talk}<form><label>{filler(2)}</label><textarea>x</textarea><button>{filler(1)}</button></form></section>',
        f'<div class="related-posts"><h4>{filler(2)}</h4></div>', f'<div class="related"><ul>{links(5, 4)}</ul></div>', f'<aside class="promo"><p>{filler(12)}</p></aside>', f'<div class="social-share"><a href="#">{filler(1)}</a> <a href="#">{filler(1)}</a></div>',
        f'<div class="newsletter"><p>{filler(11)}</p><input><button>{filler(1)}</button></div>', f"<ul>{links(6, 2)}</ul>", f'<div class="sidebar"><div class="widget">{filler(15)}</div></div>', f'<p class="copyright">{filler(6)}</p>',
    ]
    return "".join(r.sample(parts, r.randrange(2, 6)))


def amid(r: random.Random) -> str:
    """A box that readers skip inside of content."""
    return r.choice(
        [
            f'<div class="ad">{filler(r.randrange(3, 12))}</div>', f'<div class="newsletter"><p>{filler(9)}</p></div>', f'<aside><p>{filler(10)}</p></aside>', f'<div class="share">{filler(2)}</div>', f'<div class="related"><a href="/">{filler(5)}</a></div>',
            f'<nav class="toc"><ul>{links(4, 2)}</ul></nav>', f"<form><label>{filler(2)}</label><button>{filler(1)}</button></form>",
        ]
    )


#: What holds content, and what may stand around the whole page and yet names something else.
HOLDERS = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>"), ('<div id="content"><article>', "</article></div>"), ('<td valign="top">', "</td>"), ("<section>", "</section>"), ("", "")]
AROUND = [("", "")] * 4 + [("<form action='/'>", "</form>"), ('<div class="page-widget">', "</div>"), ('<div id="modal">', "</div>"), ('<div class="social">', "</div>"), ('<main class="comment">', "</main>"), ('<section class="hero">', "</section>"), ('<div class="promo">', "</div>"), ('<div class="site-legal">', "</div>"), ('<div id="nav">', "</div>")]


@cache
def pages() -> list[list[tuple[bool, str]]]:
    """(content?, markup) parts of each page."""

    def one(r: random.Random) -> Iterator[tuple[bool, str]]:
        (head, tail), (first, last) = r.choice(HOLDERS), r.choice(AROUND)
        yield False, f"<html><head><title>{filler(6)}</title></head><body>{before(r)}"
        yield True, first
        yield False, head
        # A box around the whole page has most of its words.
        yield True, body(r, 8 if first else 2)
        if r.random() < 0.4:
            yield False, amid(r)
            yield True, body(r)
        yield False, tail
        yield True, last
        yield False, f"{after(r)}</body></html>"

    return [list(one(random.Random(i))) for i in range(PAGES)]
