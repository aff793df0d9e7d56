"""The small labelled table for the block classifier: pages put together by rule, every block marked main text or not."""

from __future__ import annotations

import random

WORDS = "the of and a to in is was for on with by from that this it as at be are der die und das la le de en que y les un une".split()


def _sentence(r: random.Random, n: int) -> str:
    words = [r.choice(WORDS) if r.random() < 0.45 else "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def _prose(r: random.Random) -> str:
    return " ".join(_sentence(r, r.randint(4, 16)) for _ in range(r.choice((1, 1, 2, 3, 6))))


def _parts(r: random.Random) -> list[tuple[str, int]]:
    """(html, 1 for main text) of one page in order; one part may hold several blocks of the same kind."""
    link = lambda n: "".join(f'<li><a href="/x">{_sentence(r, r.randint(1, 2))[:-1]}</a></li>' for _ in range(n))
    body = [(f"<h1>{_sentence(r, r.randint(2, 8))[:-1]}</h1>", 1)]
    for _ in range(r.randint(2, 6)):
        body.append(r.choice(((f"<p>{_prose(r)}</p>", 1), (f"<p>{_prose(r)}</p>", 1), (f"<p>{_prose(r)}</p>", 1), (f"<h2>{_sentence(r, 3)[:-1]}</h2><p>{_prose(r)}</p>", 1),
                              (f"<blockquote>{_prose(r)}</blockquote>", 1), (f"<ul><li>{_sentence(r, 6)}</li><li>{_sentence(r, 5)}</li></ul>", 1),
                              (f"<pre>{_sentence(r, 8)}</pre>", 1), (f"<div>{_prose(r)}</div>", 1), (f'<div class="text">{_prose(r)}</div>', 1), (f"<table><tr><td>{_sentence(r, 2)}</td><td>{r.randint(1, 99)}</td></tr></table>", 1),
                              (f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "promo"))}">{_prose(r)}</div>', 0),
                              (f'<aside>{_prose(r)}</aside>', 0), (f'<div class="{r.choice(("related", "share", "newsletter"))}">{_sentence(r, 4)}</div>', 0))))
    opening, closing = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ("<main><article>", "</article></main>"), ("<section>", "</section>")))
    before = [r.choice(((f"<nav><ul>{link(r.randint(2, 6))}</ul></nav>", 0), (f'<div class="menu"><ul>{link(4)}</ul></div>', 0), (f'<div id="navbar">{_sentence(r, 3)}</div>', 0))),
              r.choice(((f"<header><p>{_sentence(r, 4)}</p></header>", 0), (f'<div class="header">{_sentence(r, 4)}</div>', 0), ("", 0))),
              r.choice(((f'<div class="{r.choice(("cookie", "notice", "banner", "consent", "alert"))}"><p>{_prose(r)}</p></div>', 0), (f'<div class="ad">{_prose(r)}</div>', 0), ("", 0)))]
    after = [r.choice(((f'<div class="{r.choice(("comments", "comment", "replies"))}"><p>{_prose(r)}</p><p>{_prose(r)}</p></div>', 0), (f'<section id="comments"><h3>Comments</h3><p>{_prose(r)}</p></section>', 0), ("", 0))),
             r.choice(((f'<aside class="sidebar"><h3>{_sentence(r, 2)}</h3><p>{_prose(r)}</p></aside>', 0), (f'<div class="sidebar"><ul>{link(3)}</ul></div>', 0), ("", 0))),
             r.choice(((f"<form><p>{_sentence(r, 5)}</p><button>Send</button></form>", 0), (f'<div class="subscribe"><form><label>{_sentence(r, 3)}</label></form></div>', 0), ("", 0))),
             r.choice(((f"<footer>&copy; {_sentence(r, 5)}</footer>", 0), (f'<div class="footer"><p>Copyright {_sentence(r, 4)}</p></div>', 0)))]
    return [*before, (opening, -1), *body, (closing, -1), *after]


def labelled_pages(n: int = 150, seed: int = 11) -> list[tuple[str, list[int]]]:
    """(page, labels of its blocks in order)."""
    from .html_blocks import blocks_of
    r, rows = random.Random(seed), []
    for _ in range(n):
        parts = _parts(r)
        labels: list[int] = []
        for piece, label in parts:
            if label >= 0:
                labels += [label] * len(blocks_of(piece))
        rows.append(("<html><head><title>t</title></head><body>" + "".join(p for p, _ in parts) + "</body></html>", labels))
    return rows
