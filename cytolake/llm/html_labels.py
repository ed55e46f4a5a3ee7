"""Labelled pages for the classifier of ``html_extract``, and the fit of its weights.

No table has labels of blocks, so pages are laid out here from parts whose label is known: articles in article or main
elements, in named or unnamed boxes, or bare in the body; menus, headers, footers, sidebars, notices, adverts, forms and
reader comments with and without names; names that only sound like boilerplate; pages of a single sentence. Words are
invented, as no feature looks at words but those of legal notes. ``fitted`` is a ridge logistic regression by Newton's
method; ``html_extract.WEIGHTS`` holds its result, rounded, and a test holds the two together.
"""

from __future__ import annotations

import random

import numpy as np

from .html_extract import Block, blocks, features

PAGES, SEED, RIDGE = 600, 17, 0.5


def _words(rng: random.Random, n: int, stops: bool = True) -> str:
    own = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    for k in range(rng.randint(5, 12), n, 9):
        own[k] += rng.choice(",.;") if stops else ""
    return " ".join(own).capitalize() + ("." if stops else "")


class _Page:
    """Html, and the label of each text in it."""

    def __init__(self, rng: random.Random):
        self.rng, self.labels = rng, {}

    def say(self, good: bool, n: int, stops: bool = True, lead: str = "") -> str:
        text = lead + _words(self.rng, n, stops)
        self.labels[text] = good
        return text

    def links(self, good: bool, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.say(good, self.rng.randint(1, 3), False)}</a></li>' for _ in range(n))

    def paragraphs(self, good: bool, n: int, short: bool = False) -> str:
        rng = self.rng
        return "".join(f"<p>{self.say(good, rng.randint(4, 14) if short else rng.randint(12, 90))}" + rng.choice(("</p>", "</p>", "")) for _ in range(n))

    def menu(self) -> str:
        n = self.rng.randint(3, 7)
        return self.rng.choice(("<nav><ul>{}</ul></nav>", '<div class="navbar"><ul>{}</ul></div>', "<ul>{}</ul>", '<ul id="mainMenu">{}</ul>', '<div role="navigation"><ul>{}</ul></div>')).format(self.links(False, n))

    def head(self) -> str:
        inside = f"<h2>{self.say(False, 2, False)}</h2><p>{self.say(False, self.rng.randint(3, 7), False)}</p>"
        return self.rng.choice(("<header>{}</header>", '<div class="site-header">{}</div>', '<div id="masthead">{}</div>')).format(inside)

    def foot(self) -> str:
        rng = self.rng
        lead = rng.choice(("\u00a9 2024 ", "Copyright 2023 ", "All rights reserved. ", "Terms of use apply to ", "Privacy and cookies: ", ""))
        plain = bool(lead) and rng.random() < 0.5
        text = self.say(False, rng.randint(3, 16), lead=lead)
        return rng.choice(("<p>{}</p>", "<div>{}</div>") if plain else ("<footer>{}</footer>", '<div class="footer"><p>{}</p></div>', '<div id="pageFooter">{}</div>')).format(text)

    def side(self) -> str:
        inside = self.rng.choice((lambda: f"<ul>{self.links(False, 4)}</ul>", lambda: self.paragraphs(False, 2, True), lambda: self.paragraphs(False, 1)))()
        return self.rng.choice(("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="rightSidebar">{}</div>', '<div class="widget related-posts">{}</div>')).format(inside)

    def advert(self) -> str:
        text = self.say(False, self.rng.randint(3, 30))
        return self.rng.choice(('<div class="ad">{}</div>', '<div class="ad-slot"><p>{}</p></div>', '<div id="sponsoredBox">{}</div>', '<div class="promo banner"><p>{}</p></div>')).format(text)

    def notice(self) -> str:
        text = self.say(False, self.rng.randint(4, 25), lead=self.rng.choice(("", "We use cookies. ")))
        return self.rng.choice(('<div class="cookie-banner"><p>{}</p></div>', '<div role="alert">{}</div>', '<div class="notice">{}</div>', '<div hidden>{}</div>', '<div style="display: none"><p>{}</p></div>')).format(text)

    def form(self) -> str:
        return f"<form><label>{self.say(False, 3, False)}</label><button>{self.say(False, 1, False)}</button></form>"

    def comments(self) -> str:
        inside = "".join(self.rng.choice((f"<div><p>{self.say(False, self.rng.randint(5, 50))}</p></div>", f"<p>{self.say(False, self.rng.randint(5, 40))}</p>")) for _ in range(self.rng.randint(1, 4)))
        return self.rng.choice(('<div class="comments">{}</div>', '<section id="comments"><h3>' + self.say(False, 1, False) + "</h3>{}</section>", '<div class="userComments">{}</div>', '<ol class="comment-list"><li>{}</li></ol>', '<div id="respond">{}</div>')).format(inside)

    def body(self) -> str:
        """An article's own blocks."""
        rng = self.rng
        out = [rng.choice((f"<h1>{self.say(True, rng.randint(3, 9), False)}</h1>", f"<h2>{self.say(True, 4, False)}</h2>", ""))]
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.6:
                out.append(self.paragraphs(True, rng.randint(1, 3)))
            elif kind < 0.7:
                out.append(f"<ul>{''.join(f'<li>{self.say(True, rng.randint(5, 20))}</li>' for _ in range(3))}</ul>")
            elif kind < 0.8:
                out.append(f"<h3>{self.say(True, rng.randint(2, 6), False)}</h3><p>{self.say(True, 30)}</p>")
            elif kind < 0.9:
                name = rng.choice(("social-history", "related-work", "share-price", "comment-on-method", "ad-hoc-notes", "menu-planning", "notice-period", "promo-effects"))
                out.append(f'<section id="{name}">{self.paragraphs(True, rng.randint(1, 2))}</section>')
            else:
                out.append(f"<blockquote>{self.say(True, rng.randint(10, 40))}</blockquote><div>{self.say(True, rng.randint(15, 60))}</div>")
        return "".join(out)

    def build(self) -> str:
        rng = self.rng
        if rng.random() < 0.08:
            return "<html><body>" + rng.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(self.say(True, rng.randint(3, 12))) + "</body></html>"
        some = lambda part, p: part() if rng.random() < p else ""
        between = lambda: some(self.advert, 0.15) + some(self.side, 0.1)
        inner = self.body() + some(self.advert, 0.2) + (self.body() if rng.random() < 0.3 else "") + some(self.comments, 0.2)
        wrap = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', '<div class="entry-content">{}</div>', "<div>{}</div>", "{}", '<div id="mainContent">{}</div>'))
        if rng.random() < 0.1 and "<article" in wrap:
            wrap = rng.choice(('<div class="with-sidebar">', '<form action="/">', '<div class="social-history">')) + wrap
        parts = [some(self.head, 0.5), some(self.menu, 0.7), some(self.notice, 0.3), between(), wrap.format(inner), between(), some(self.comments, 0.3), some(self.side, 0.4), some(self.form, 0.2), some(self.foot, 0.8)]
        return "<html><body>" + "".join(parts) + "</body></html>"


def pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, dict[str, bool]]]:
    """Pages, each with its texts and whether they are content."""
    out = []
    for i in range(n):
        page = _Page(random.Random(seed * 1_000_003 + i))
        out.append((page.build(), page.labels))
    return out


def labelled(sample: list[tuple[str, dict[str, bool]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks."""
    x, y = [], []
    for html, labels in sample:
        rows: list[Block] = blocks(html)
        for row, f in zip(rows, features(rows), strict=True):
            x.append(f)
            y.append(float(labels[row.text]))
    return np.array(x), np.array(y)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a penalty on all but the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w
