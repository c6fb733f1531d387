"""Labelled pages for the block classifier of HTML extraction, and its fit.

Pages are made from random layouts: an article in a named or unnamed container (some
with names that sound like furniture), among menus, headers, adverts, notices, sidebars,
forms, comments and footers that tell their role by element, by class, or by their text
and their place alone. The label of a block
is known from its making. The classifier is a logistic regression on ``PAGES``
pages; the scale of the smoothness edges is the one with the fewest wrong blocks on
as many other pages.
"""

from __future__ import annotations

import functools
import random

import numpy as np

from .html_extract import blocks_of, content_of, features

#: Pages to fit on, and pages to choose the scale of the edges on.
PAGES = 400
SCALES = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)
#: Names that sites give their parts. Half of the parts have a name of random letters instead, so that what they hold and
#: where they stand tells them apart; some articles have a name that sounds like furniture.
CONTAINERS = ("<article>", "<main>", '<div id="content">', '<div class="post-body">', '<div class="story">', "<div>", "<div>", "<section>")
ADVERTS = ('<div class="ad">', '<div class="ad-box">', '<div id="sponsor">', '<div class="promo">', '<div class="banner">', "<aside>", "<div>")
SIDES = ("<aside>", '<div class="sidebar">', '<div id="related">', '<section class="recommended">', '<div class="widget">', "<div>")
NOTICES = ('<div class="cookie-notice">', '<div id="consent">', '<div class="alert">', "<div>")
COMMENTS = ('<section id="comments">', '<div class="comment-list">', '<div id="disqus">', '<div class="replies">')
HEADS = ("<header>", '<div class="masthead">', '<div id="header">')
FEET = ("<footer>", '<div class="footer">', '<div id="legal">', "<div>")
MISLEADING = ("rail-travel", "reply-brief", "feedback-loops", "alert-levels", "navigation-history", "comment-on-trade", "sponsor-law", "feed-prices")
SLOGANS = ("We use cookies to improve things.", "Sign up for our newsletter", "All rights reserved.", "Privacy policy", "Log in", "Subscribe now", "© 2020 by us")


class PageMaker:
    """A random page: ``html`` and the texts of its content blocks."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.content: set[str] = set()
        self.parts: list[str] = []

    def words(self, least: int, most: int) -> str:
        r = self.random
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(r.randint(least, most)))

    def sentence(self, least: int, most: int) -> str:
        return self.words(least, most).capitalize() + self.random.choice([".", ".", ".", "!", "?", ""])

    def text(self, least: int, most: int) -> str:
        """A sentence of the content."""
        out = self.sentence(least, most)
        self.content.add(out)
        return out

    def put(self, opening: str, *inside: str) -> None:
        self.parts += [opening, *inside, f"</{opening[1:].split()[0].rstrip('>')}>"]

    def named(self, openings: tuple[str, ...]) -> str:
        """One of the openings; half of those that tell their part by a name get one of random letters."""
        opening = self.random.choice(openings)
        if "=" in opening and self.random.random() < 0.5:
            return f'<{opening[1:].split()[0]} class="{self.words(1, 1)}">'
        return opening

    def signed(self) -> str:
        """A reader's name with a time, in one of several forms."""
        r = self.random
        who, when = self.words(1, 2), r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(2005, 2024)}", f"{r.randint(2, 59)} minutes ago", f"{r.randint(10, 23)}:{r.randint(10, 59)}", f"{self.words(1, 1)} {r.randint(2005, 2024)}"])
        return r.choice([f"<span>{who}</span> {when}<br>", f"<p>{who} {when}</p>", f"<div>{who} wrote {when}</div>", f"<h4>{who}</h4><p>{when}</p>"])

    def comments(self) -> None:
        r = self.random
        opening, one = self.named(COMMENTS), r.choice(["<div>", f'<div class="{self.words(1, 1)}">', "<li>", "<article>"])
        n, plain = r.randint(2, 6), r.random() < 0.3 and "=" in opening and any(opening == c for c in COMMENTS)
        inside = [f"<p>{self.sentence(4, 50)}</p>" if plain else f"{one}{self.signed()}<p>{self.sentence(4, 50)}</p></{one[1:].split()[0].rstrip('>')}>" for _ in range(n)]
        self.put(opening, *(["<h3>" + self.words(1, 3) + "</h3>"] if r.random() < 0.4 else []), *inside)

    def beside(self) -> None:
        """A remark beside the text, inside the article."""
        self.put("<aside>", f"<p>{self.sentence(4, 40)}</p>")

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{self.words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def wrap(self, text: str) -> str:
        return f"<p>{text}</p>" if self.random.random() < 0.3 else f"<span>{text}</span><br>"

    def advert(self) -> None:
        inside = self.random.random()
        text = self.sentence(3, 14)
        self.put(self.named(ADVERTS) if inside > 0.5 else self.random.choice(ADVERTS), f"<p>{text}</p>" if inside < 0.2 else text if inside < 0.5 else f'<a href="#">{self.words(2, 8)}</a>')

    def article(self) -> None:
        r = self.random
        container = f'<{r.choice(["div", "section", "article"])} class="{r.choice(MISLEADING)}">' if r.random() < 0.1 else r.choice(CONTAINERS)
        self.parts.append(container)
        if r.random() < 0.85:
            self.put("<h1>", self.text(2, 10))
        for _ in range(r.randint(2, 14)):
            kind = r.random()
            if kind < 0.6:
                self.put("<p>", self.text(8, 80))
            elif kind < 0.75:
                self.put("<p>", self.text(1, 6))
            elif kind < 0.82:
                self.put(r.choice(["<h2>", "<h3>"]), self.text(1, 6))
            elif kind < 0.88:
                self.put("<ul>", *(f"<li>{self.text(1, 14)}</li>" for _ in range(r.randint(2, 5))))
            elif kind < 0.92:
                self.put("<blockquote>", self.text(5, 40))
            elif kind < 0.95:
                self.put("<div>", self.text(1, 4) if r.random() < 0.5 else self.text(4, 40))
            elif kind < 0.98:
                self.advert()
            else:
                self.beside()
        self.parts.append(f"</{container[1:].split()[0].rstrip('>')}>")

    def page(self) -> str:
        r = self.random
        if r.random() < 0.5:
            self.put(r.choice(HEADS), f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 6)}</p>" if r.random() < 0.5 else "")
        if r.random() < 0.8:
            self.put(r.choice(["<nav>", '<div class="menu">', "<div>"]), self.links(r.randint(3, 9)))
        if r.random() < 0.3:
            self.put(r.choice(NOTICES), self.wrap(r.choice(SLOGANS)))
        if r.random() < 0.5:
            self.advert()
        self.article()
        if r.random() < 0.4:
            self.comments()
        if r.random() < 0.4:
            self.put(self.named(SIDES), f"<h3>{self.words(1, 3)}</h3>", self.links(r.randint(2, 6)))
        if r.random() < 0.3:
            self.put("<form>", self.wrap(r.choice(SLOGANS)))
        if r.random() < 0.8:
            self.put(self.named(FEET), self.wrap(r.choice(SLOGANS)), self.wrap(self.words(2, 8)) if r.random() < 0.5 else "")
        return f"<html><body>{''.join(self.parts)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[list, np.ndarray]]:
    """The blocks of ``n`` pages with 1 for content, 0 for the rest."""
    out = []
    for k in range(n):
        maker = PageMaker(seed + k)
        blocks = blocks_of(maker.page())
        out.append((blocks, np.array([b.text in maker.content for b in blocks], dtype=float)))
    return out


def logistic_regression(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@functools.lru_cache(maxsize=1)
def fit(pages: int = PAGES, seed: int = 1) -> tuple[np.ndarray, float]:
    """The classifier's weights and the scale of the smoothness edges."""
    train = labelled_pages(pages, seed)
    w = logistic_regression(np.concatenate([features(b) for b, _ in train]), np.concatenate([y for _, y in train]))
    other = labelled_pages(pages, seed + pages)
    wrong = {s: sum(int((np.array(content_of(b, w, s)) != (y > 0)).sum()) for b, y in other) for s in SCALES}
    return w, min(SCALES, key=lambda s: (wrong[s], s))
