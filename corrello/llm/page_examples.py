"""Labelled pages from which the costs of main-text extraction are learned.

Pages are written by rule from a seed: an article and what stands around it, in
layouts from fully marked-up to bare, with the truth of every block known.  The
words are invented, so nothing but layout and form can be learned.
"""

from __future__ import annotations

import random

_PARTS = "ba den fo gri hul ja kem lor mi nat ope pir que ros sul tam uve wix yol zan".split()
#: Class names the examples use for what does not belong to the article.
_OFF = "menu sidebar ad advert cookie-notice comments related-links share-bar newsletter promo breadcrumbs".split()


class _Page:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.truth: dict[str, bool] = {}

    def words(self, low: int, high: int, end: str = "") -> str:
        r = self.rng
        return " ".join("".join(r.choice(_PARTS) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))).capitalize() + end

    def block(self, tag: str, text: str, content: bool, link: bool = False) -> str:
        self.truth[text] = content
        return f"<{tag}>" + (f'<a href="/x">{text}</a>' if link else text) + f"</{tag}>"

    def links(self, content: bool = False, low: int = 3, high: int = 8) -> str:
        tag = self.rng.choice(("li", "li", "p", "div"))
        return "<ul>" + "".join(self.block(tag, self.words(1, 3, self.rng.choice(("", "", "", ".", ","))), content, True) for _ in range(self.rng.randint(low, high))) + "</ul>"

    def prose(self, content: bool, count: int) -> str:
        r, out = self.rng, ""
        para = r.choice(("p", "p", "p", "div"))
        for _ in range(count):
            kind = r.random()
            if kind < 0.12:
                out += self.block(r.choice(("h2", "h3")), self.words(2, 6), content)
            elif kind < 0.24:
                out += self.block(para, self.words(2, 5, r.choice((".", "", ":"))), content)
            elif kind < 0.3:
                out += self.block(para, self.words(3, 9, "."), content, True)
            elif kind < 0.36:
                out += self.block("blockquote", self.words(8, 30, "."), content)
            else:
                out += self.block(para, self.words(12, 90, r.choice((".", "!", "?"))), content)
        return out

    def off(self, name: str) -> str:
        """A part that does not belong to the article, below its class name."""
        r = self.rng
        kind = r.random()
        inner = self.links() if kind < 0.4 else self.prose(False, r.randint(1, 3)) if kind < 0.8 else self.block("p", self.words(2, 8), False)
        tag = r.choice(("div", "section", "aside" if name in ("sidebar", "related-links") else "div"))
        return f'<{tag} class="{name}">{inner}</{tag}>'

    def article(self) -> str:
        r = self.rng
        out = self.block("h1", self.words(3, 9), True) + self.prose(True, r.randint(1, 4))
        for _ in range(r.randint(0, 2)):
            out += self.off(r.choice(_OFF)) if r.random() < 0.6 else f"<aside>{self.prose(False, r.randint(1, 2))}</aside>"
            out += self.prose(True, r.randint(1, 4))
        return out

    def page(self) -> str:
        r = self.rng
        marked = r.random()
        nav, foot = self.links(), self.block("p", self.words(3, 14, r.choice(("", ".", "."))), False)
        before = "".join(self.off(r.choice(_OFF)) for _ in range(r.randint(0, 2)))
        after = "".join(self.off(r.choice(_OFF)) for _ in range(r.randint(0, 2)))
        if marked < 0.4:  # every part has its element
            body = f"<article>{self.article()}</article>"
            body = f"<main>{body}</main>" if r.random() < 0.5 else body
            if r.random() < 0.4:  # readers' comments may be articles too
                body += f'<section id="comments"><article>{self.prose(False, 2)}</article></section>'
            if r.random() < 0.4:
                body += f"<form>{self.block('p', self.words(2, 6), False)}</form>"
            return f"<body><nav>{nav}</nav>{before}{body}{after}<footer>{foot}</footer></body>"
        if marked < 0.7:  # names only
            name = r.choice(("content", "post-body", "entry", "main-text", "story"))
            return f'<body><div id="menu">{nav}</div>{before}<div class="{name}">{self.article()}</div>{after}<div class="footer">{foot}</div></body>'
        if marked < 0.8:
            return f"<body><header>{nav}</header><main>{self.article()}</main>{after}<footer>{foot}</footer></body>"
        body = self.block("h1", self.words(3, 9), True) + self.prose(True, r.randint(3, 8))  # bare
        return f"<body><div>{nav}</div><div>{body}</div><div>{foot}{self.links(low=2, high=4)}</div></body>"


def labelled_pages(count: int, seed: int) -> list[tuple[str, dict[str, bool]]]:
    """Pages, and for each the truth of its blocks' texts: True for the article's."""
    out = []
    for i in range(count):
        page = _Page(seed * 1_000_003 + i)
        out.append((page.page(), page.truth))
    return out


def plain_pages(count: int, seed: int) -> list[tuple[str, dict[str, bool]]]:
    """Pages that are an article and nothing else, from a few words on, unmarked."""
    out = []
    for i in range(count):
        page = _Page(seed * 1_000_003 + i)
        r = page.rng
        head = page.block("h1", page.words(1, 6), True) if r.random() < 0.5 else ""
        body = head + "".join(page.block(r.choice(("p", "p", "div")), page.words(1, r.choice((2, 8, 60)), r.choice((".", "", "!"))), True) for _ in range(r.randint(1, 4)))
        out.append((f"<body>{body}</body>" if r.random() < 0.5 else body, page.truth))
    return out
